"""Queries of chunking and symbols: documents as text files, small sources as literals with hand-computed results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefall.functions import text as X
from orefall.operators import chunking as C
from orefall.plans.registry import register
from orefall.session import spread
from orefall.plans.views import DOCS, docs, literals, read, sql_values

LINES = f"""{DOCS}, lines AS (SELECT file, string_split(text, chr(10)) AS l FROM docs WHERE text <> ''),
win AS (SELECT file, l, unnest(range(CAST(floor((len(l) - 1) / 100) AS BIGINT) + 1)) AS i FROM lines),
chunks AS (SELECT file, 'chunk_' || (i * 100) AS chunk, CAST(i * 100 + 1 AS INTEGER) AS start_line, CAST(least(len(l), i * 100 + 100) AS INTEGER) AS end_line, array_to_string(l[i * 100 + 1:i * 100 + 100], chr(10)) AS content FROM win)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("file", F.col("text").alias("content"))


@register("line_chunks", f"WITH {LINES} SELECT file, chunk, start_line, end_line, content FROM chunks")
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.line_windows(texts(spark, sf_dir))


@register("chunk_sizes", f"WITH {LINES} SELECT count(*) AS n, CAST(min(length(content)) AS INTEGER) AS least, CAST(max(length(content)) AS INTEGER) AS most, CAST(max(end_line - start_line + 1) AS INTEGER) AS lines FROM chunks")
def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.line_windows(texts(spark, sf_dir))
    return c.agg(F.count("*").alias("n"), F.min(F.length("content")).alias("least"), F.max(F.length("content")).alias("most"), F.max(F.col("end_line") - F.col("start_line") + 1).alias("lines"))


_long = "".join(f"    def m{i}(self):\n        return {i}  # {'x' * 90}\n" for i in range(20))
SOURCES = [
    ("a.py", "import os\nX = 1\n\nclass A:\n    v = 1\n    def f(self):\n        return os\n\ndef tiny():\n    pass\n\ndef long_function_name(a, b):\n    value = a + b\n    return value * 2\n"),
    ("big.py", f'class Big:\n    """Doc."""\n    n: int = 3\n{_long}'),
    ("script.py", "import sys\nprint(sys.argv)\n"),
    ("broken.py", "def f(:\n  pass"),
    ("m.c", "#include <a.h>\nint g = 1;\nint add(int a, int b) {\n  return a + b; // }\n}\nstruct P {\n  int x;\n};\n"),
    ("n.ts", "const s = \"{\";\nfunction run(a) {\n  if (a) { return 1; }\n}\nclass K {\n  go() { return 2; }\n}\n"),
    ("h.h", "#define A 1\n"),
    ("t.txt", "one\ntwo"),
    ("e.py", ""),
]
_S = "file string, content string"
# Hand-computed: type, name and first line of each chunk in order.
EXPECTED_CHUNKS = [
    ("a.py", 0, "class", "A", 4), ("a.py", 1, "function", "long_function_name", 12),
    *[("big.py", i, "method", f"m{i}", 4 + 2 * i) for i in range(20)],
    ("script.py", 0, "script", "main", 1), ("broken.py", 0, "text_chunk", "chunk_0", 1),
    ("m.c", 0, "function", "add", 2), ("m.c", 1, "class", "P", 5),
    ("n.ts", 0, "function", "run", 1), ("n.ts", 1, "class", "K", 4),
    ("h.h", 0, "global_context", "header", 1), ("t.txt", 0, "text_chunk", "chunk_0", 1),
]
_E = "file string, ord int, type string, name string, start_line int"


def sources(spark: SparkSession) -> DataFrame:
    return literals(spark, _S, SOURCES)


def _chunk_query(name: str, keep: str):
    rows = [r for r in EXPECTED_CHUNKS if (r[0].endswith(".py")) == (keep == "py") and (r[0] != "t.txt" or keep == "all")] if keep != "all" else EXPECTED_CHUNKS
    rows = [r for r in rows if keep == "all" or r[0] != "t.txt"]

    @register(name, f"WITH {sql_values('t', _E, rows)} SELECT file, ord, type, name, start_line FROM t")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = sources(spark)
        s = s if keep == "all" else s.where(F.col("file").endswith(".py") if keep == "py" else ~F.col("file").endswith(".py") & (F.col("file") != "t.txt"))
        return C.chunk_files(s).select("file", "ord", "type", "name", "start_line")

    return query


python_chunks = _chunk_query("python_chunks", "py")
cstyle_chunks = _chunk_query("cstyle_chunks", "brace")
chunk_dispatch = _chunk_query("chunk_dispatch", "all")

_syms = [("a.py", "  [C] A|    - f|  [F] tiny|  [F] long_function_name"), ("script.py", ""), ("broken.py", "")]


@register("symbols_py", f"WITH {sql_values('t', 'file string, symbols string', _syms)} SELECT file, symbols FROM t WHERE symbols <> ''")
def symbols_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.symbols(sources(spark).where("file IN ('a.py', 'script.py', 'broken.py')"))
    return s.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "symbol"))), lambda x: x["symbol"]), "|").alias("symbols"))


_code = [("X.java", "public class X {\n  // no\n  public int size() {\n  private void go(int a) {\n  if (x) {\n"), ("y.go", "type T struct {\nfunc (t *T) Run() {\nfunc Main() {\n"), ("z.ts", "class Q {\nfunction abc(a) {\nconst fff = (a) => {\nreturn (x) => {\n")]
_codesyms = [("X.java", "  [C] X|    - size"), ("y.go", "  [C] T|    - Run|    - Main"), ("z.ts", "  [C] Q|    - abc|    - fff")]


@register("symbols_regex", f"WITH {sql_values('t', 'file string, symbols string', _codesyms)} SELECT file, symbols FROM t")
def symbols_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.symbols(literals(spark, _S, _code))
    return s.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "symbol"))), lambda x: x["symbol"]), "|").alias("symbols"))


# Sources made of the words of each document; the SQL says what chunks and symbols they have without parsing them.
_WORDS = """w AS (SELECT file, regexp_extract_all(text, '[a-zA-Z]+') AS words FROM docs)"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(docs(spark, sf_dir), "doc_id").select("file", F.regexp_extract_all("text", F.lit("([a-zA-Z]+)")).alias("words"))


def _lines_of(words: str, make) -> Column:
    return F.array_join(F.transform(words, make), "")


@register(
    "symbols_of_documents",
    f"""WITH {DOCS}, {_WORDS}, s AS (SELECT file, ['  [C] ' || words[1]] || list_transform(list_filter(words, lambda x: length(x) > 2 AND x NOT IN ('if', 'for', 'switch', 'while', 'catch', 'return')), lambda x: '    - ' || x) AS s
    FROM w WHERE len(words) > 0) SELECT file, CAST(len(s[1:41]) AS INTEGER) AS n, array_to_string(s[1:41], '|') AS symbols FROM s""",
)
def symbols_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type and a function for each word, as a script source."""
    w = _words(spark, sf_dir).where("size(words) > 0")
    body = _lines_of("words", lambda x: F.concat(F.lit("  function "), x, F.lit("(a) {\n    console.log(a)\n  }\n")))
    files = w.select(F.concat("file", F.lit(".ts")).alias("file"), F.concat(F.lit("class "), F.col("words")[0], F.lit(" {\n"), body, F.lit("}\n")).alias("content"))
    found = C.symbols(files).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", "symbol"))).alias("s"))
    return found.select(F.regexp_replace("file", "\\.ts$", "").alias("file"), F.size("s").alias("n"), F.array_join(F.transform("s", lambda x: x["symbol"]), "|").alias("symbols"))


@register(
    "blocks_of_documents",
    f"""WITH {DOCS}, {_WORDS} SELECT file, CAST(i - 1 AS INTEGER) AS ord, CASE WHEN words[i] IN ('if', 'for', 'while', 'switch', 'catch', 'return', 'sizeof') THEN 'code_block' ELSE 'function' END AS type,
    CASE WHEN words[i] IN ('if', 'for', 'while', 'switch', 'catch', 'return', 'sizeof') THEN 'anonymous' ELSE words[i] END AS name, CAST(greatest(1, 4 * i - 4) AS INTEGER) AS start_line
    FROM (SELECT file, words, unnest(range(1, len(words) + 1)) AS i FROM w)""",
)
def blocks_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block for each word, with braces in a string and a comment."""
    body = _lines_of("words", lambda x: F.concat(F.lit("int "), x, F.lit('(int a) {\n  f("{"); // {\n  return a;\n}\n')))
    files = _words(spark, sf_dir).select(F.concat("file", F.lit(".c")).alias("file"), body.alias("content"))
    found = C.chunk_files(files, columns=("file", "ord", "type", "name", "start_line"))
    return found.withColumn("file", F.expr("left(file, length(file) - 2)"))


@register(
    "functions_of_documents",
    f"""WITH {DOCS}, {_WORDS} SELECT file, CAST(i - 1 AS INTEGER) AS ord, 'function' AS type, 'f_' || words[i] AS name, CAST(3 * i AS INTEGER) AS start_line,
    '# --- Context ---' || chr(10) || 'import os' || chr(10) || '# ---------------' || chr(10) || 'def f_' || words[i] || '(value):' || chr(10) || '    return os.path.join(str(value), "a constant text")' AS content
    FROM (SELECT file, words, unnest(range(1, len(words) + 1)) AS i FROM w)""",
)
def functions_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function for each word, under one import."""
    body = _lines_of("words", lambda x: F.concat(F.lit("\ndef f_"), x, F.lit('(value):\n    return os.path.join(str(value), "a constant text")\n')))
    files = _words(spark, sf_dir).where("size(words) > 0").select(F.concat("file", F.lit(".py")).alias("file"), F.concat(F.lit("import os\n"), body).alias("content"))
    found = C.chunk_files(files, columns=("file", "ord", "type", "name", "start_line", "content"))
    return found.withColumn("file", F.expr("left(file, length(file) - 3)"))


T = "```"
_blocks = [("b1", f"{T}python\nx = 1\n{T}", 1.0), ("b2", f"{T}\nx =\n{T}\n{T}py\ny = 2\n{T}", 0.5), ("b3", "no code", 1.0)]


@register("code_correct", f"WITH {sql_values('t', 'id string, text string, correct double', _blocks)} SELECT id, correct FROM t")
def code_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = literals(spark, "id string, text string, correct double", _blocks)
    return C.code_correct(b.select("id", X.code_blocks(F.col("text")).alias("blocks")))


# Files asked for: those already indexed (documents with a label) are skipped, empty ones fail, the others give chunks.
@register("jit_index", f"WITH {LINES} SELECT c.file, count(*) AS n_chunks FROM chunks c JOIN docs d ON d.file = c.file WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY c.file")
def jit_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch, chunk and index what is not indexed yet."""
    indexed = read(spark, sf_dir, "labels").select("doc_id").distinct()
    wanted = docs(spark, sf_dir).select("doc_id", "file", F.col("text").alias("content")).join(indexed, "doc_id", "left_anti")
    return C.chunk_files(wanted).groupBy("file").agg(F.count("*").alias("n_chunks"))


@register("chat_index", f"WITH {sql_values('t', 'file string, ord int, name string', [('a.py', 0, 'A')])} SELECT file, ord, name FROM t")
def chat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As chunking, with functions under 100 characters left out."""
    return C.chunk_files(sources(spark).where("file = 'a.py'"), least=100).select("file", "ord", "name")
