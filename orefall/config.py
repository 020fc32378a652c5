"""Limits and fixed values of the evidence and evaluation operators."""

from __future__ import annotations

from dataclasses import dataclass


# Weights, limits and bounds of retrieval, routes, cleaning and training samples.
@dataclass(frozen=True)
class Retrieval:
    rrf_k: int = 60
    weight_vector: float = 1.0
    weight_bm25: float = 0.3
    oversample: int = 2
    top_k: int = 3
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_floor: float = 0.25
    vector_floor: float = 0.0


@dataclass(frozen=True)
class Routes:
    weights: tuple[float, ...] = (1.0, 0.82, 0.78, 0.72)
    expanded: float = 0.9


@dataclass(frozen=True)
class Cleaning:
    min_score: float = 0.7
    min_faithfulness: float = 0.6
    min_relevance: float = 0.6
    min_query: int = 10
    min_answer: int = 100
    min_context: int = 50
    max_context: int = 4000


@dataclass(frozen=True)
class SftLengths:
    query: int = 500
    context: int = 2500
    answer: int = 3000
    total: int = 6000


RETRIEVAL, ROUTES, CLEANING, SFT = Retrieval(), Routes(), Cleaning(), SftLengths()

# Queries that are small talk, alone or before a blank.
CHATTY = (
    "你好", "您好", "嗨", "在吗", "在不在", "谢谢", "多谢", "再见", "拜拜", "什么是", "你是谁", "你叫什么", "帮帮我", "教教我",
    "hello", "hi", "hey", "thanks", "thank you", "bye", "goodbye", "what is", "who are you", "help me", "can you",
    "test", "测试", "ok", "yes", "no",
)
# Substrings that show code.
CODE_MARKS = ("def ", "class ", "import ", "from ", "function ", "const ", "let ", "var ", "public ", "private ", "void ", "func ", "package ", "```")
# Words that a claim's faithfulness ignores.
JUDGE_STOP = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall "
    "can need dare ought used to of in for on with at by from as into that which who whom this these those it its"
).split()
# Words that claim tokens leave out.
CLAIM_STOP = ("the", "and", "for", "with", "that", "this", "from", "into", "using", "use", "在", "对", "的", "与", "和", "并", "进行", "用于", "通过", "实现", "其他")
# Tiers and their lower bounds.
TIERS = (("gold", 0.9), ("silver", 0.7), ("bronze", 0.5))
# What a repository scan leaves out.
IGNORED_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".mp4", ".webp", ".pyc", ".pyo", ".lock", ".zip", ".tar", ".gz",
    ".pdf", ".woff", ".woff2", ".DS_Store", ".gitignore", ".gitattributes", ".editorconfig",
)
IGNORED_DIRECTORIES = (
    ".git", ".github", ".vscode", ".idea", "__pycache__", "node_modules", "venv", "env", ".env", "build", "dist",
    "site-packages", "migrations", ".next", ".nuxt", "coverage", "vendor", "target", "out", "bin", "obj",
)
MAX_FILE_SIZE = 500_000
# Files that a repository map takes first.
PRIORITY_EXTENSIONS = (".py", ".java", ".go", ".js", ".ts", ".tsx", ".cpp", ".cs", ".rs")
PRIORITY_KEYWORDS = ("main", "app", "core", "api", "service", "utils", "controller", "model", "config")
# The mark between head and tail of a shortened text.
ELLIPSIS = "\n\n... [中间内容已省略] ...\n\n"
TRUNCATED = "\n... [truncated]"
ANSWER_CUT = "\n\n... [回答过长，已截断]"
INSTRUCTION = "你是一个专业的GitHub代码仓库分析助手。根据提供的代码上下文，准确回答用户关于代码实现、架构设计、功能逻辑等问题。回答时应该：1) 直接引用相关代码 2) 解释代码的工作原理 3) 如有必要，提供代码示例。"
# Issue and commit patterns.
REPRO_PATTERN = (
    r"reproduc|cannot\s+repro|can'?t\s+repro|repro\s|cuda|docker|dependenc|pip\s|conda|environment|venv|build\s+fail|"
    r"install\s+fail|wheel|version\s+mismatch|requirements"
)
SEVERE_PATTERN = "cuda|docker|dependenc|reproduc"
FEATURE_PATTERN = r"^(feat|feature)(\(|!|:|\b)"
# Repository signals (pattern, weight) by dimension.
SIGNALS: dict[str, tuple[tuple[str, float], ...]] = {
    "code_structure": (
        (r"(src|lib|app|pkg|cmd)/", 0.25),
        (r"(main|index|__main__)\.(py|ts|js|go|rs)$", 0.20),
        (r"tests?/|_test\.(py|go|rs)$|\.test\.(ts|js)$", 0.20),
        (r"(Makefile|justfile|taskfile\.yml)$", 0.15),
        (r"\.github/workflows/", 0.10),
        (r"(setup\.py|pyproject\.toml|Cargo\.toml|go\.mod|package\.json|pom\.xml)$", 0.10),
    ),
    "docs_quality": (
        (r"README(\.\w+)?$", 0.35),
        (r"(CONTRIBUTING|CHANGELOG|HISTORY)(\.\w+)?$", 0.15),
        (r"(docs?|documentation)/", 0.20),
        (r"LICENSE(\.\w+)?$", 0.15),
        (r"(examples?|tutorials?|notebooks?)/", 0.15),
    ),
    "env_readiness": (
        (
            r"(requirements.*\.txt|Pipfile|poetry\.lock|setup\.cfg|pyproject\.toml|go\.sum|Cargo\.lock|package-lock\.json|yarn\.lock|pnpm-lock\.yaml)$",
            0.30,
        ),
        (r"Dockerfile|docker-compose", 0.25),
        (r"\.env\.example|\.env\.sample", 0.15),
        (r"(Makefile|scripts/.*\.(sh|bash))$", 0.15),
        (r"(setup\.py|pyproject\.toml|Cargo\.toml|go\.mod|package\.json)$", 0.15),
    ),
    "community_stability": (
        (r"\.github/(ISSUE_TEMPLATE|PULL_REQUEST_TEMPLATE)", 0.25),
        (r"(CONTRIBUTING|CODE_OF_CONDUCT)(\.\w+)?$", 0.25),
        (r"\.github/workflows/", 0.20),
        (r"SECURITY(\.\w+)?$", 0.15),
        (r"(CHANGELOG|HISTORY)(\.\w+)?$", 0.15),
    ),
}
# Paper links.
ARXIV_PDF = r"(?i)https?://arxiv\.org/pdf/[\w.]+(?:\.pdf)?"
ARXIV_ABS = r"(?i)https?://arxiv\.org/abs/[\w.]+"
OPENREVIEW = r"(?i)https?://openreview\.net/(?:forum|pdf)\?id=[\w-]+"
GENERIC_PDF = r"""(?i)https?://[^\s)>\]"']+\.pdf(?:\?[^\s)>\]"']*)?"""
CODE_PATH = r"([A-Za-z0-9_./-]+\.(?:py|js|ts|tsx|jsx|java|go|rs|cpp|c|h|cs|php|rb|kt|scala|swift))"
# Symbol patterns (types, functions) by family of languages; Java's classes nest, so the bracket within one is escaped.
SYMBOL_PATTERNS = {
    "java": (
        r"(?:public|protected|private)?\s*(?:static|abstract)?\s*(?:class|interface|enum)\s+([a-zA-Z0-9_]+)",
        r"(?:public|protected|private)\s+(?:static\s+)?[\w<>\[\]]+\s+([a-zA-Z0-9_]+)\s*\(",
    ),
    "ts": (
        r"class\s+([a-zA-Z0-9_]+)",
        r"(?:function\s+([a-zA-Z0-9_]+)|const\s+([a-zA-Z0-9_]+)\s*=\s*(?:async\s*)?\(|([a-zA-Z0-9_]+)\s*\([^)]*\)\s*[:\{])",
    ),
    "go": (
        r"type\s+([a-zA-Z0-9_]+)\s+(?:struct|interface)",
        r"func\s+(?:(?:\(.*\)\s+)?([a-zA-Z0-9_]+)|([a-zA-Z0-9_]+)\()",
    ),
}
# The family of an extension (others: ts), starts of lines without symbols, names that are no functions, symbols of a file.
SYMBOL_FAMILIES = {"java": "java", "cs": "java", "cpp": "java", "rs": "java", "go": "go"}
SYMBOL_NOISE = ("//", "/*", "*", "#", "print", "console.")
SYMBOL_NO_NAMES = ("if", "for", "switch", "while", "catch", "return")
MAX_SYMBOLS = 41
