"""Static code metrics per file: a projection over (path, content), without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultgauge.functions import lexical, paths
from faultgauge.functions.pinned import pinned
from faultgauge.functions.python_ast import ast_facts

METRIC_COLUMNS = [
    "loc", "sloc", "cyclomatic_complexity", "length", "volume", "difficulty", "num_operators",
    "num_operands", "branch_count", "int_fan_in", "int_fan_out", "language",
]


def kind_counts(tokens: Column) -> Column:
    """Total and distinct tokens."""
    return F.struct(F.size(tokens).alias("n"), F.size(F.array_distinct(tokens)).alias("eta"))


def token_counts(clean: Column) -> Column:
    """Totals and distinct counts of both token kinds, in one file: keywords are operators, other words operands."""
    once = lexical.computed_once
    of_words = once(
        lexical.words(clean), lambda words: F.struct(kind_counts(words).alias("all"), once(lexical.keywords(words), kind_counts).alias("keywords"))
    )
    return once(
        F.struct(once(lexical.symbols(clean), kind_counts).alias("symbols"), of_words.alias("words")),
        lambda found: F.struct(
            (found.symbols.n + found.words.keywords.n).alias("n1"),
            (found.words.all.n - found.words.keywords.n).alias("n2"),
            (found.symbols.eta + found.words.keywords.eta).alias("eta1"),
            (found.words.all.eta - found.words.keywords.eta).alias("eta2"),
        ),
    )


def halstead_volume(n1: Column, n2: Column, eta1: Column, eta2: Column) -> Column:
    eta = eta1 + eta2
    return F.when(eta > 0, (n1 + n2) * F.log2(eta.cast("double"))).otherwise(0.0)


def halstead_difficulty(n1: Column, n2: Column, eta1: Column, eta2: Column) -> Column:
    return F.when(eta2 > 0, (eta1 / F.lit(2.0)) * (n2 / eta2)).otherwise(0.0)


def clean_text(content: Column, lang: Column) -> Column:
    return lexical.mask_strings(lexical.strip_comments(content, lang))


def lexical_counts(files: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``, the lexical counts of the column ``text`` read as ``language``; null where there is no text."""
    def counts(clean: Column) -> Column:
        return F.struct(
            token_counts(clean).alias("tokens"),
            lexical.decision_count(clean, F.col("language")).alias("decisions"),
            lexical.definition_count(clean).alias("definitions"),
            lexical.call_count(clean).alias("calls"),
        )

    found = lexical.computed_once(clean_text(F.col(text), F.col("language")), counts)
    return files.withColumn(name, pinned(F.when(F.col(text).isNotNull(), found)))


def python_facts(files: DataFrame) -> DataFrame:
    """Add ``ast``, the grammar facts of Python files; null elsewhere and where parsing fails."""
    return files.withColumn("ast", pinned(ast_facts(F.col("_python_code"))))


def measured_counts() -> Column:
    """One set of counts per file: from the grammar where the file parses, else from the lexical route."""
    ast, lex = F.col("ast"), F.coalesce("_lex", "_rest")
    cyclo = ast.decisions + 1
    by_grammar = F.struct(
        F.struct(ast.n1.alias("n1"), ast.n2.alias("n2"), ast.eta1.alias("eta1"), ast.eta2.alias("eta2")).alias("tokens"),
        cyclo.alias("cyclo"),
        F.greatest(ast.branches, ast.decisions).alias("branches"),
        (ast.definitions + ast.classes).alias("fan_in"),
        F.greatest(F.lit(0), ast.calls - ast.definitions).alias("fan_out"),
    )
    by_tokens = F.struct(
        lex.tokens.alias("tokens"),
        (lex.decisions + 1).alias("cyclo"),
        (lex.decisions * 2).alias("branches"),
        F.greatest(F.lit(1), lex.definitions).alias("fan_in"),
        F.greatest(F.lit(0), lex.calls - lex.definitions).alias("fan_out"),
    )
    return F.when(ast.decisions.isNotNull(), by_grammar).otherwise(by_tokens)


def file_metrics(files: DataFrame) -> DataFrame:
    """Add the 12-field metric record to every row of ``files(path, content, …)``.

    A file without a path is read as generic code. A blank file gets the all-zero record. Files that are not Python
    are reduced to counts first. Python sources alone travel to a worker, which reads them by their grammar; those
    that do not parse are then counted like the others. No text is read by both routes or part of the result.
    """
    content = F.col("content")
    blank = F.col("_blank")
    lang = F.when(F.coalesce(F.col("path"), F.lit("")) == "", "generic").otherwise(paths.language(F.col("path")))
    keep = [c for c in files.columns if c != "content"]

    read = files.withColumns({"language": lang, "_blank": lexical.is_blank(content)})
    by_grammar = (F.col("language") == "python") & ~blank
    others = lexical_counts(read.withColumn("_other", F.when(~by_grammar, content)), "_other", "_lex").drop("_other")
    counted = others.withColumns(
        {
            "_lines": pinned(lexical.line_counts(content)),
            # Merged with the Python step, this one would send every text and token list through it.
            "_python_code": pinned(F.when(by_grammar, content)),
        }
    )
    parsed = python_facts(counted).withColumn("_unread", pinned(F.when(F.col("ast.decisions").isNull(), F.col("_python_code"))))
    measured = lexical_counts(parsed, "_unread", "_rest")
    m = F.col("_m")
    t = m.tokens
    counts = (t.n1, t.n2, t.eta1, t.eta2)

    def unless_blank(value: Column, empty) -> Column:
        return pinned(F.when(blank, F.lit(empty)).otherwise(value))

    def number(value: Column, empty: float = 0.0) -> Column:
        return unless_blank(value.cast("double"), empty)

    sloc = F.greatest(F.lit(1), F.col("_lines.total") - F.col("_lines.blank") - F.col("_lines.comment"))
    return (
        measured.withColumn("_m", pinned(measured_counts()))
        .select(
            *[F.col(c) for c in keep],
            unless_blank(F.col("_lines.total"), 0).alias("loc"),
            unless_blank(sloc, 0).alias("sloc"),
            number(m.cyclo, 1.0).alias("cyclomatic_complexity"),
            number(t.n1 + t.n2).alias("length"),
            number(halstead_volume(*counts)).alias("volume"),
            number(halstead_difficulty(*counts)).alias("difficulty"),
            number(t.n1).alias("num_operators"),
            number(t.n2).alias("num_operands"),
            number(m.branches).alias("branch_count"),
            number(m.fan_in).alias("int_fan_in"),
            number(m.fan_out).alias("int_fan_out"),
            unless_blank(F.col("language"), "empty").alias("language"),
        )
    )


def operator_tokens(files: DataFrame, key: str) -> DataFrame:
    """How often each operator occurs in each file."""
    return _token_table(files, key, lexical.operators)


def operand_tokens(files: DataFrame, key: str) -> DataFrame:
    """How often each operand occurs in each file."""
    return _token_table(files, key, lexical.operands)


def _token_table(files: DataFrame, key: str, extract) -> DataFrame:
    lang = paths.language(F.col("path"))
    return (
        files.select(key, clean_text(F.col("content"), lang).alias("_clean"))
        .select(key, F.explode(extract(F.col("_clean"))).alias("token"))
        .groupBy(key, "token")
        .agg(F.count("*").alias("n"))
    )
