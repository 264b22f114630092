"""Fixed values that the SQL expects, written out: it shares none of them with the code that it checks."""

# --- fixed values -----------------------------------------------------------------------------------

FEATURES = ['LOC', 'CYCLO', 'LENGTH', 'VOLUME', 'DIFFICULTY', 'INT_FAN_IN', 'INT_FAN_OUT', 'NUM_OPERATORS', 'NUM_OPERANDS', 'BRANCH_COUNT']
METRIC_OF_FEATURE = {'LOC': 'loc',
 'CYCLO': 'cyclomatic_complexity',
 'LENGTH': 'length',
 'VOLUME': 'volume',
 'DIFFICULTY': 'difficulty',
 'INT_FAN_IN': 'int_fan_in',
 'INT_FAN_OUT': 'int_fan_out',
 'NUM_OPERATORS': 'num_operators',
 'NUM_OPERANDS': 'num_operands',
 'BRANCH_COUNT': 'branch_count'}
SUPPORTED_EXTENSIONS = ['py', 'js', 'ts', 'tsx', 'jsx', 'mjs', 'cjs', 'java', 'go', 'cpp', 'c', 'cc', 'cxx', 'h', 'hpp', 'cs', 'php', 'rb']
LANGUAGE_BY_EXTENSION = {'py': 'python',
 'js': 'javascript',
 'jsx': 'javascript_react',
 'mjs': 'javascript',
 'cjs': 'javascript',
 'ts': 'typescript',
 'tsx': 'typescript_react',
 'java': 'java',
 'go': 'go',
 'c': 'c',
 'cpp': 'cpp',
 'cc': 'cpp',
 'cxx': 'cpp',
 'h': 'c_header',
 'hpp': 'cpp_header',
 'cs': 'csharp',
 'php': 'php',
 'rb': 'ruby'}
DISPLAY_LANGUAGE = {'py': 'Python',
 'js': 'JavaScript',
 'ts': 'TypeScript',
 'tsx': 'TypeScript/React',
 'jsx': 'JavaScript/React',
 'java': 'Java',
 'go': 'Go',
 'cpp': 'C++',
 'c': 'C',
 'cs': 'C#',
 'php': 'PHP',
 'rb': 'Ruby'}
OPERATOR_SYMBOLS = ['===', '!==', '==', '!=', '<=', '>=', '<<', '>>', '++', '--', '+=', '-=', '*=', '/=', '%=', '->', '::', '?.', '??', '&&', '||',
 '+', '-', '*', '/', '%', '=', '<', '>', '!', '&', '|', '^', '~', '?', ':']
OPERATOR_KEYWORDS = ['if', 'else', 'elif', 'for', 'foreach', 'while', 'do', 'switch', 'case', 'default', 'break', 'continue', 'return', 'throw',
 'try', 'catch', 'finally', 'new', 'delete', 'typeof', 'instanceof', 'await', 'async', 'def', 'function', 'fn', 'class', 'import',
 'from', 'export', 'package', 'public', 'private', 'protected', 'static']
DECISION_WORDS = {'generic': ['if', 'for', 'while', 'case', 'catch'],
 'c': ['if', 'for', 'while', 'case'],
 'go': ['if', 'for', 'case', 'select'],
 'php': ['if', 'for', 'foreach', 'while', 'case', 'catch'],
 'ruby': ['if', 'unless', 'for', 'while', 'until', 'when', 'rescue', 'and', 'or']}
DECISION_SYMBOLS = {'generic': ['&&', '||', '?'], 'c': ['&&', '||', '?'], 'go': ['&&', '||'], 'php': ['&&', '||', '?'], 'ruby': ['&&', '||']}
DEFINITION_WORDS = ['def', 'function', 'fn']
MEMBER_WORDS = ['public', 'private', 'protected', 'static', 'void', 'int', 'String', 'bool']
SCALING_BOUNDS = {'LOC': (0.0, 1500.0, 'Lines of Code'),
 'CYCLO': (1.0, 25.0, 'McCabe Cyclomatic Complexity v(G)'),
 'LENGTH': (0.0, 3000.0, 'Halstead Total Program Length (N)'),
 'VOLUME': (0.0, 25000.0, 'Halstead Program Volume (V)'),
 'DIFFICULTY': (0.0, 100.0, 'Halstead Difficulty (D)'),
 'INT_FAN_IN': (0.0, 15.0, 'Internal Definitions / Entry Points'),
 'INT_FAN_OUT': (0.0, 25.0, 'Function / Method Invocations'),
 'NUM_OPERATORS': (0.0, 800.0, 'Total Operator Count (N1)'),
 'NUM_OPERANDS': (0.0, 800.0, 'Total Operand Count (N2)'),
 'BRANCH_COUNT': (0.0, 30.0, 'Decision Branch Count')}
DEFAULT_RECOMMENDATION = 'Maintain existing unit test coverage and review for edge cases during pull request reviews.'
CONTRACT_FAILURE_RECOMMENDATION = 'Unable to extract complete metric schema for this file.'
MISSING_FEATURES_PREFIX = ('Prediction could not be performed because the extracted feature schema does not match the trained model. Missing required '
 'features: ')
GENERIC_EVIDENCE = 'a combination of size and control-flow density'
EXPLANATION_CLOSE = 'These structural patterns increase cognitive load and make edge cases harder to test thoroughly.'
NO_SUPPORTED_FILES = 'No supported source code files found in repository.'
ALL_FILES_EMPTY = 'All discovered code files were empty or inaccessible.'
NO_EXPLANATION = 'No AI explanation available.'
NO_ACTION = 'Review and refactor code.'
HEALTHY_FILE = 'This file appears healthy. No immediate action required.'
REVIEW_NEXT_SPRINT = 'Review this file during your next sprint and ensure test coverage for all public methods.'
SEED = 42
TEST_SHARE = 0.2
N_FOLDS = 5
THRESHOLDS = [0.15 + k * 0.02 for k in range(25)]
EXTENSION_CYCLE = ['py', 'js', 'ts', 'tsx', 'jsx', 'java', 'go', 'cpp', 'c', 'cs', 'php', 'rb', 'xyz']
BLANK_TEXT = '  \n\t\n '
