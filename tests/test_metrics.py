"""Metric records of a small code corpus, and of texts that are easy to get wrong."""

import random
import re

import pytest
from pyspark.sql import functions as F

from faultgauge import constants as C
from faultgauge.functions import lexical
from faultgauge.operators.metrics import file_metrics, token_counts

LEDGER = """class Ledger:
    def total(self, lines):
        amount = 0
        while lines:
            amount += lines.pop()
        return amount
"""

DRAIN = """// drain a queue
function drain(queue, limit) {
  let n = 0;
  while (queue.length > 0 && n < limit) {
    queue.shift();
    n += 1;
  }
  return n;
}
"""

STOCK = """public class Stock {
    private int left;
    /* take some */
    public int take(int n) {
        if (n > left || n < 0) {
            return 0;
        }
        left -= n;
        return n;
    }
}
"""

# every kind of node that counts, once or twice
KINDS = """class Box:
    pass
async def load(source, flag=-1):
    async with source as opened:
        async for item in opened:
            yield item
    with open(source) as f, flag:
        assert f
    try:
        rest = [x + 1 for x in f if x > 2 if x]
    except OSError:
        rest = 3 if flag else 4
    for y in rest:
        while y and not flag or source:
            break
    if rest:
        return
"""

# Worked out by hand, node by node and line by line. Operands of the ledger: Ledger, total, amount, 0, lines, amount,
# pop, lines, amount; its operators: while and one call.
CORPUS = [
    ("ledger.py", LEDGER, dict(loc=6, sloc=6, cyclomatic_complexity=2, branch_count=1, int_fan_in=2, int_fan_out=0,
                               num_operators=2, num_operands=9, volume=33.0, difficulty=1.5, language="python")),
    ("half.py", "def half(n): return n / 2", dict(loc=1, sloc=1, cyclomatic_complexity=1, branch_count=0, int_fan_in=1,
                                                  int_fan_out=0, num_operators=1, num_operands=3, volume=8.0, difficulty=0.5)),
    # decisions: async with, async for, with, assert, comprehension with two conditions (3), except, conditional value,
    # for, while, and/or (2), if; branches: async for 1, comprehension 3, except 1, value 2, for 1, while 1, and/or 2, if 1
    ("kinds.py", KINDS, dict(loc=17, sloc=17, cyclomatic_complexity=15, branch_count=14, int_fan_in=2, int_fan_out=0)),
    ("drain.js", DRAIN, dict(loc=9, sloc=8, cyclomatic_complexity=3, branch_count=4, int_fan_in=1, int_fan_out=2,
                             language="javascript")),
    ("Stock.java", STOCK, dict(loc=11, sloc=10, cyclomatic_complexity=3, branch_count=4, language="java")),
    ("void.py", "", dict(loc=0, sloc=0, cyclomatic_complexity=1, branch_count=0, int_fan_in=0, int_fan_out=0,
                         num_operators=0, num_operands=0, volume=0, difficulty=0, language="empty")),
    ("blank.js", "\t\n  \n", dict(loc=0, cyclomatic_complexity=1, language="empty")),
    ("null.js", None, dict(loc=0, cyclomatic_complexity=1, num_operators=0, language="empty")),
]

# Only the fields named are checked.
AWKWARD = [
    # a line comment is cut before strings are masked, so the quote stays open
    ("url.js", 'u = "http://x";\ny = 1', dict(num_operators=3, num_operands=4)),
    ("nullish.js", "a ?? b", dict(cyclomatic_complexity=3, branch_count=4, num_operators=1, num_operands=2)),
    ("go.go", "a ?? b || c", dict(cyclomatic_complexity=2)),
    ("names.js", "naïve = été + 1", dict(num_operators=2, num_operands=1)),
    ("crlf.js", "a\r\nb\r\n\r\n", dict(loc=3, sloc=2)),
    ("tail.js", "\n\n a\n  ", dict(loc=4, sloc=1)),
    ("separators.js", "a\x0cb\u2028c\x85d", dict(loc=4, sloc=4)),
    ("marks.c", "#include <x>\n*p = 1;\n// c\n/* d */\nint a;", dict(loc=5, sloc=1)),
    ("open.js", 'x = "abc', dict(num_operators=1, num_operands=2)),
    ("long.js", 'x = "' + "a" * 200_000 + '"', dict(num_operators=1, num_operands=2)),
    ("escapes.js", 'x = "' + "\\n" * 50_000 + '"', dict(num_operators=1, num_operands=2)),
    ("number.js", "3.14 1.2.3 5.x 7.5abc", dict(num_operands=6)),
    ("broken.py", "def f(:\n    if x and y:\n", dict(language="python", cyclomatic_complexity=2, int_fan_in=1)),
    ("null.py", "x = 1\0", dict(language="python", num_operators=1)),
    ("task.rb", "if a and b\n  run\nend # note", dict(language="ruby", cyclomatic_complexity=3)),
    ("view.tsx", "case x: catch (e) {}", dict(language="typescript_react", cyclomatic_complexity=3)),
    ("head.h", "catch (e) {}", dict(language="c_header", cyclomatic_complexity=2)),
    ("plain.c", "catch (e) {}", dict(language="c", cyclomatic_complexity=1)),
    ("nested.java", "public foo(static bar(x))", dict(int_fan_in=2, int_fan_out=0)),
    ("", "if (a) { b() }", dict(language="generic", cyclomatic_complexity=2, int_fan_out=2)),
    ("all.py", "async def f():\n    async for a in b: pass\n    async with c: assert d if e else g\n"
     "    return [x for x in y if x if z]\ntry:\n    while not k: pass\nexcept E:\n    h.m(-1)\nclass K: pass\n",
     dict(cyclomatic_complexity=10, int_fan_in=2, int_fan_out=0, branch_count=9, num_operators=10)),
    ("match.py", "match a:\n    case 1: b += 2\n    case _: pass\n",
     dict(cyclomatic_complexity=1, branch_count=0, num_operators=0, num_operands=4, int_fan_in=0)),
]


@pytest.fixture(scope="module")
def measured(spark):
    rows = [(p, c) for p, c, _ in CORPUS] + [(p, c) for p, c, _ in AWKWARD]
    frame = spark.createDataFrame(rows, "path string, content string")
    return {r["path"]: r.asDict() for r in file_metrics(frame.repartition(3)).collect()}


@pytest.mark.parametrize("path,expected", [(p, e) for p, _, e in CORPUS], ids=lambda x: str(x)[:20])
def test_corpus(measured, path, expected):
    got = measured[path]
    for field, value in expected.items():
        assert got[field] == (value if isinstance(value, str) else pytest.approx(value, abs=1e-4)), field
    assert got["length"] == got["num_operators"] + got["num_operands"]


@pytest.mark.parametrize("path,expected", [(p, e) for p, _, e in AWKWARD], ids=lambda x: str(x)[:20])
def test_awkward_texts(measured, path, expected):
    got = measured[path]
    assert {k: got[k] for k in expected} == expected


def test_each_text_is_read_by_one_route(spark):
    code = "def f(a):\n    return a if a else 0\n"
    rows = [("a.py", code), ("b.py", code + "("), ("c.js", code), ("d.py", " "), (None, code), ("e.py", "x = '\0'"), ("f.py", "(" * 500)]
    got = {r.path: r for r in file_metrics(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got["a.py"].cyclomatic_complexity == 2 and got["a.py"].num_operators == 1  # if_exp
    assert got["b.py"].num_operators > 1 and got["c.js"].num_operators > 1 and got[None].language == "generic"
    assert got["d.py"].language == "empty" and got["e.py"].cyclomatic_complexity == 1 and got["f.py"].loc == 1


def test_measuring_needs_no_shuffle_and_sends_only_python_code(spark):
    frame = spark.createDataFrame([("a.py", "x")], "path string, content string")
    plan = file_metrics(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("ArrowEvalPython") == 1
    # above the grammar step, tokens are those of Python files that it could not read
    above = plan[: plan.index("ArrowEvalPython")]
    assert "content#" not in above and re.search(r"CASE WHEN isnull\(ast#\d+\.decisions\) THEN _python_code#\d+ END", above)


def lines_by_force(text):
    blanks = "\t\x1f \xa0   　" + "".join(map(chr, range(0x2000, 0x200B)))
    lines = re.split("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", text)
    if lines[-1] == "":
        lines.pop()  # the text ends with a break, or is empty
    bare = [line.lstrip(blanks) for line in lines]
    # an empty last line is one that a break follows
    return len(lines), bare.count(""), sum(b.startswith(("#", "//", "/*", "*")) for b in bare)


def calls_by_force(text):
    return len(re.findall(r"(?<!\w)[a-zA-Z_][a-zA-Z0-9_]*(?!\w)[\s]*\(", text))


def test_lines_and_calls_equal_brute_force(spark):
    draw = random.Random(7)
    marks = ["\n", "\r", "\r\n", " ", "\t", "\xa0", "\x85", " ", "#", "//", "/*", "*", "/", "a", "f", "é", "1", "_", "(", ")", "\U0001f600"]
    texts = ["", "\n", "  ", "a\n  ", "a\n", *("".join(draw.choices(marks, k=draw.randint(1, 12))) for _ in range(3000))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = rows.select("text", lexical.line_counts(F.col("text")).alias("lines"), lexical.call_count(F.col("text")).alias("calls")).collect()
    for r in found:
        assert tuple(r.lines) == lines_by_force(r.text), repr(r.text)
        assert r.calls == calls_by_force(r.text), repr(r.text)
    assert spark.createDataFrame([(None,)], "text string").select(lexical.line_counts(F.col("text")).alias("lines")).first().lines is None


def test_lines_are_counted_by_one_scan(spark):
    measured = file_metrics(spark.createDataFrame([("a.js", "x\n")], "path string, content string"))
    plan = measured._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_extract_all\(concat\(\s*, content#", plan)) == 1 and "split(content" not in plan


# The counts of tokens, definitions and decisions, each by a pattern of its own. A character of two code units is a letter
# to what comes before it alone.
BEFORE, AFTER, NAME = r"(?<![^\W\U00010000-\U0010ffff])", r"(?!\w)", "[a-zA-Z_][a-zA-Z0-9_]*+"
KEYWORD = f"(?:{'|'.join(C.OPERATOR_KEYWORDS)}){AFTER}"
OPERATORS = f"{'|'.join(re.escape(s) for s in C.OPERATOR_SYMBOLS)}|{BEFORE}{KEYWORD}"
OPERANDS = rf"{BEFORE}(?!{KEYWORD})(?:{NAME}{AFTER}|\d++(?:\.\d++)?{AFTER})"
DEFINED = [
    rf"{BEFORE}(?:def|function|fn)\s++{NAME}", rf"{BEFORE}class\s++{NAME}",
    rf"{BEFORE}(?:{'|'.join(C.MEMBER_WORDS)})\s++{NAME}\s*+\(",
]


def decided(language):
    words, marks = C.DECISION_WORDS[language], C.DECISION_SYMBOLS[language]
    return f"{BEFORE}(?:{'|'.join(words)}){AFTER}|{'|'.join(re.escape(m) for m in marks)}"


def test_tokens_definitions_and_decisions_equal_brute_force(spark):
    draw = random.Random(11)
    marks = [" ", "\n", "\xa0", "a", "x1", "é", "_", "1", "23", "٣", "²", ".", "(", "\U0001f600", "\U0001d400", "\U0001d7d9", "when", "String"]
    pools = (marks + C.OPERATOR_SYMBOLS, marks + C.OPERATOR_KEYWORDS, ["class", "def", "fn", "int", "void", "name", " ", " ", " ", "(", "é"])
    texts = ["", "\U0001d400if", "a\U0001d7d9\U0001d7d9", "1.\U0001d7d9", "7.5abc", "class class class A", "class def fn x"]
    texts += ["".join(draw.choices(pools[i % 3], k=draw.randint(1, 14))) for i in range(6000)]
    text = F.col("text")
    languages = [F.struct(F.lit(n).alias("name"), lexical.decision_count(text, F.lit(n)).alias("n")) for n in C.DECISION_WORDS]
    found = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", lexical.operators(text).alias("operators"), lexical.operands(text).alias("operands"),
        lexical.definition_count(text).alias("definitions"), token_counts(text).alias("counts"), F.array(*languages).alias("decisions"),
    )
    for r in found.collect():
        operators, operands = re.findall(OPERATORS, r.text), re.findall(OPERANDS, r.text)
        assert sorted(r.operators) == sorted(operators) and r.operands == operands, repr(r.text)
        assert tuple(r.counts) == (len(operators), len(operands), len(set(operators)), len(set(operands))), repr(r.text)
        assert r.definitions == sum(len(re.findall(p, r.text)) for p in DEFINED), repr(r.text)
        assert all(d.n == len(re.findall(decided(d.name), r.text)) for d in r.decisions), repr(r.text)


def test_words_are_found_by_one_scan_and_not_copied(spark):
    measured = file_metrics(spark.createDataFrame([("a.js", "x\n")], "path string, content string"))
    plan = measured._jdf.queryExecution().optimizedPlan().toString()
    # keywords are told from other words by a set, and not by trying each of them at every word
    assert "instanceof|" not in plan and plan.count("instanceof") > 0
    # one scan on either route for the three kinds of definitions, and no projection of texts or tokens in between
    assert plan.count("private|protected") == 2 and "AS _clean" not in plan and "AS _operands" not in plan
