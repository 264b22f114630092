"""Names, word lists, bounds and texts that results depend on."""

# --- fixed values: file extensions -------------------------------------------------------------

SUPPORTED_EXTENSIONS = [
    "py", "js", "ts", "tsx", "jsx", "mjs", "cjs", "java", "go", "cpp", "c", "cc", "cxx", "h", "hpp",
    "cs", "php", "rb",
]

LANGUAGE_BY_EXTENSION = {
    "py": "python",
    "js": "javascript",
    "jsx": "javascript_react",
    "mjs": "javascript",
    "cjs": "javascript",
    "ts": "typescript",
    "tsx": "typescript_react",
    "java": "java",
    "go": "go",
    "c": "c",
    "cpp": "cpp",
    "cc": "cpp",
    "cxx": "cpp",
    "h": "c_header",
    "hpp": "cpp_header",
    "cs": "csharp",
    "php": "php",
    "rb": "ruby",
}

DISPLAY_LANGUAGE = {
    "py": "Python",
    "js": "JavaScript",
    "ts": "TypeScript",
    "tsx": "TypeScript/React",
    "jsx": "JavaScript/React",
    "java": "Java",
    "go": "Go",
    "cpp": "C++",
    "c": "C",
    "cs": "C#",
    "php": "PHP",
    "rb": "Ruby",
}

# --- fixed values: operator symbols (longest first) and keywords ---------------------------------

OPERATOR_SYMBOLS = [
    "===", "!==", "==", "!=", "<=", ">=", "<<", ">>", "++", "--", "+=", "-=", "*=", "/=", "%=",
    "->", "::", "?.", "??", "&&", "||",
    "+", "-", "*", "/", "%", "=", "<", ">", "!", "&", "|", "^", "~", "?", ":",
]

OPERATOR_KEYWORDS = [
    "if", "else", "elif", "for", "foreach", "while", "do", "switch", "case", "default", "break",
    "continue", "return", "throw", "try", "catch", "finally", "new", "delete", "typeof",
    "instanceof", "await", "async", "def", "function", "fn", "class", "import", "from", "export",
    "package", "public", "private", "protected", "static",
]

# Decision words and symbols per language; a language that is not listed uses "generic".
# `??` counts as two decisions, because a single `?` matches first.
DECISION_WORDS = {
    "generic": ["if", "for", "while", "case", "catch"],
    "c": ["if", "for", "while", "case"],
    "go": ["if", "for", "case", "select"],
    "php": ["if", "for", "foreach", "while", "case", "catch"],
    "ruby": ["if", "unless", "for", "while", "until", "when", "rescue", "and", "or"],
}
DECISION_SYMBOLS = {
    "generic": ["&&", "||", "?"],
    "c": ["&&", "||", "?"],
    "go": ["&&", "||"],
    "php": ["&&", "||", "?"],
    "ruby": ["&&", "||"],
}

DEFINITION_WORDS = ["def", "function", "fn"]
MEMBER_WORDS = ["public", "private", "protected", "static", "void", "int", "String", "bool"]
COMMENT_LINE_MARKERS = ["#", "//", "/*", "*"]

# --- fixed values: the ten-feature contract -------------------------------------------------------

FEATURES = [
    "LOC", "CYCLO", "LENGTH", "VOLUME", "DIFFICULTY",
    "INT_FAN_IN", "INT_FAN_OUT", "NUM_OPERATORS", "NUM_OPERANDS", "BRANCH_COUNT",
]

# Raw metric column that feeds each feature.
METRIC_OF_FEATURE = {
    "LOC": "loc",
    "CYCLO": "cyclomatic_complexity",
    "LENGTH": "length",
    "VOLUME": "volume",
    "DIFFICULTY": "difficulty",
    "INT_FAN_IN": "int_fan_in",
    "INT_FAN_OUT": "int_fan_out",
    "NUM_OPERATORS": "num_operators",
    "NUM_OPERANDS": "num_operands",
    "BRANCH_COUNT": "branch_count",
}

# Every spelling a metric may arrive under.
FEATURE_ALIASES = {
    "LOC": ["loc", "LOC"],
    "CYCLO": ["cyclomatic_complexity", "CYCLO", "cyclo"],
    "LENGTH": ["length", "LENGTH"],
    "VOLUME": ["volume", "VOLUME"],
    "DIFFICULTY": ["difficulty", "DIFFICULTY"],
    "INT_FAN_IN": ["int_fan_in", "INT_FAN_IN"],
    "INT_FAN_OUT": ["int_fan_out", "INT_FAN_OUT"],
    "NUM_OPERATORS": ["num_operators", "NUM_OPERATORS"],
    "NUM_OPERANDS": ["num_operands", "NUM_OPERANDS"],
    "BRANCH_COUNT": ["branch_count", "BRANCH_COUNT"],
}

SCALING_BOUNDS = {
    "LOC": (0.0, 1500.0, "Lines of Code"),
    "CYCLO": (1.0, 25.0, "McCabe Cyclomatic Complexity v(G)"),
    "LENGTH": (0.0, 3000.0, "Halstead Total Program Length (N)"),
    "VOLUME": (0.0, 25000.0, "Halstead Program Volume (V)"),
    "DIFFICULTY": (0.0, 100.0, "Halstead Difficulty (D)"),
    "INT_FAN_IN": (0.0, 15.0, "Internal Definitions / Entry Points"),
    "INT_FAN_OUT": (0.0, 25.0, "Function / Method Invocations"),
    "NUM_OPERATORS": (0.0, 800.0, "Total Operator Count (N1)"),
    "NUM_OPERANDS": (0.0, 800.0, "Total Operand Count (N2)"),
    "BRANCH_COUNT": (0.0, 30.0, "Decision Branch Count"),
}

# --- fixed values: limits and tiers ---------------------------------------------------------------

HIGH_FROM = 0.70
MEDIUM_FROM = 0.40
DEFAULT_SCORE = 0.50
MAX_FILES_PER_REPO = 25
ENRICHED_FILES = 5
EXPLAINED_FILES = 3
LATEST_ANALYSES = 10
CHART_ANALYSES = 5
RECENT_RISKY_FILES = 5
TOP_LANGUAGES = 5
TOP_DIRECTORIES = 4
TOP_FACTORS = 3
TOP_RECOMMENDATIONS = 3

# --- fixed values: texts --------------------------------------------------------------------------

DEFAULT_RECOMMENDATION = (
    "Maintain existing unit test coverage and review for edge cases during pull request reviews."
)
CONTRACT_FAILURE_RECOMMENDATION = "Unable to extract complete metric schema for this file."
MISSING_FEATURES_PREFIX = (
    "Prediction could not be performed because the extracted feature schema does not match the "
    "trained model. Missing required features: "
)
GENERIC_EVIDENCE = "a combination of size and control-flow density"
EXPLANATION_CLOSE = (
    "These structural patterns increase cognitive load and make edge cases harder to test thoroughly."
)
NO_SUPPORTED_FILES = "No supported source code files found in repository."
ALL_FILES_EMPTY = "All discovered code files were empty or inaccessible."
NO_EXPLANATION = "No AI explanation available."
NO_ACTION = "Review and refactor code."
HEALTHY_FILE = "This file appears healthy. No immediate action required."
REVIEW_NEXT_SPRINT = (
    "Review this file during your next sprint and ensure test coverage for all public methods."
)

# --- fixed values: sentences, in two parts around a value ------------------------------------------

ADVICE_NESTED = (
    "Refactor deeply nested conditional branches (Cyclomatic Complexity is ", ", exceeding safe threshold of 10).",
)
ADVICE_COMPLEX = ("Consider breaking complex logic into smaller helper functions (Complexity: ", ").")
ADVICE_SPLIT = ("Split this file into smaller, modular components (Current size is ", " lines).")
ADVICE_BLOAT = ("Review module responsibilities to prevent file bloat (Current size: ", " lines).")
ADVICE_BRANCHES = ("Implement branch-coverage unit tests to verify all ", " decision paths.")
ADVICE_DIFFICULTY = ("Simplify operator-to-operand ratios (Halstead Difficulty is ", ").")
ADVICE_COUPLING = ("Reduce external coupling and dependency calls (Fan-Out is ", ").")
EVIDENCE_COMPLEX = ("high cyclomatic complexity (", ")")
EVIDENCE_SIZE = ("file size (", " lines)")
EVIDENCE_BRANCHES = ("a high branch count (", " paths)")
EVIDENCE_VOLUME = ("high code volume (", " Halstead volume)")
EVIDENCE_DENSITY = "high operator and operand density"
EVIDENCE_NESTED = ("high cyclomatic complexity (", ") with deeply nested branches")
EVIDENCE_LARGE = ("large file size (", " lines)")
EXPLANATION_FILE = ("The XGBoost model assigned ", " a ")
EXPLANATION_SCORE = ("", "% defect risk score primarily driven by ")
DEFAULT_SUGGESTION = (
    "Add unit tests covering the primary execution branches in `",
    "`; refactor complex methods to reduce nesting; verify error-handling paths.",
)

# --- fixed values: training ------------------------------------------------------------------------

SEED = 42
TEST_SHARE = 0.20
N_FOLDS = 5
# 25 thresholds from 0.15 in steps of 0.02
SWEEP_START, SWEEP_STEP, SWEEP_COUNT = 0.15, 0.02, 25

BOOSTED_CONFIGS = {
    "n=50, d=2, lr=0.01, w=1.0": dict(trees=50, depth=2, rate=0.01, rows=0.8, cols=0.8, weight=1.0),
    "n=80, d=2, lr=0.03, w=1.0": dict(trees=80, depth=2, rate=0.03, rows=0.8, cols=0.8, weight=1.0),
    "n=100, d=3, lr=0.03, w=1.0": dict(trees=100, depth=3, rate=0.03, rows=0.8, cols=0.8, weight=1.0),
    "n=150, d=4, lr=0.03, w=2.07": dict(trees=150, depth=4, rate=0.03, rows=0.8, cols=0.8, weight=2.07),
}
# the configuration of the first model, a baseline for the others
FIRST_CONFIG = dict(trees=200, depth=6, rate=0.05, rows=0.8, cols=0.8, weight=2.07)
FINAL_CONFIG = "n=100, d=3, lr=0.03, w=1.0"

# The wider grid of the recorded experiments (the first three repeat entries above).
RECORDED_CONFIGS = {
    "n=100, d=3, lr=0.05, w=1.0": dict(trees=100, depth=3, rate=0.05, rows=0.9, cols=0.9, weight=1.0),
    "n=150, d=4, lr=0.03, w=1.0": dict(trees=150, depth=4, rate=0.03, rows=0.8, cols=0.8, weight=1.0),
    "n=50, d=3, lr=0.02, w=1.5": dict(trees=50, depth=3, rate=0.02, rows=0.7, cols=0.7, weight=1.5),
    "n=80, d=2, lr=0.03, w=1.5": dict(trees=80, depth=2, rate=0.03, rows=0.7, cols=0.7, weight=1.5),
}

POSITIVE_WEIGHTS = [1.0, 1.3, 1.5, 1.8, 2.07, 2.5, 3.0]

FEATURE_SUBSETS = {
    "All features": FEATURES,
    "Size and complexity": ["LOC", "CYCLO", "BRANCH_COUNT"],
    "Halstead only": ["LENGTH", "VOLUME", "DIFFICULTY", "NUM_OPERATORS", "NUM_OPERANDS"],
    "Low redundancy": ["LOC", "CYCLO", "DIFFICULTY", "INT_FAN_IN", "INT_FAN_OUT", "BRANCH_COUNT"],
    "Most correlated": ["BRANCH_COUNT", "NUM_OPERANDS", "VOLUME", "CYCLO"],
    "BRANCH_COUNT alone": ["BRANCH_COUNT"],
    "NUM_OPERANDS alone": ["NUM_OPERANDS"],
    "CYCLO alone": ["CYCLO"],
    "LOC alone": ["LOC"],
}
