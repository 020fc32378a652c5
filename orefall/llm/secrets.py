"""Secret scans with a random forest that removes false positives.

Patterns propose candidates in whole texts: known formats, long runs of key characters with a
digit, passwords in URLs, and what is assigned to a secret word by = or :, however short or punctuated. Each candidate is described by its length and
characters, the transitions between them, how much of it a dictionary of common word parts
covers, whether it stands in a path or URL, and the words beside it. A random forest, trained
here from labelled findings, decides which candidates are secrets.

The labelled findings are made by ``labelled_findings``: for each kind, examples are drawn
from the kind's own format (keys, tokens, pass phrases; digests, ids, paths, plain words and
numbers as the false ones) with a fixed seed, set beside words that go with them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Formats of well-known credentials, and the general candidate.
CANDIDATE = re.compile(
    r"(?P<pem>-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"  # to its END line, or over the base64 lines that follow
    r"(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]{0,24}PRIVATE KEY-----|(?:(?:\s|\\[nr]){1,8}[0-9A-Za-z+/]{40,}={0,2})*(?:(?<=[0-9A-Za-z+/]{40})(?:\s|\\[nr]){1,8}(?=[A-Za-z+/]*[0-9+/=])[0-9A-Za-z+/]{4,39}={0,2}(?![^\s\\]))?))"
    r"|(?P<aws>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b)"
    r"|(?P<forge>\bgh[opsur]_[0-9A-Za-z]{36,}\b)"
    r"|(?P<chat>\bxox[abprs]-[0-9A-Za-z-]{10,})"
    r"|(?P<jwt>\beyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{4,})"
    r"|(?P<general>(?<![0-9A-Za-z+/_-])(?=[A-Za-z+/_-]*[0-9])[0-9A-Za-z+/_-]{16,}={0,2}(?![0-9A-Za-z+/_=-]))"
)
# Words that stand beside secrets, and beside things that only look like them.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private", "key")
OTHER_WORDS = ("sha", "md5", "hash", "digest", "checksum", "commit", "revision", "uuid", "guid", "etag", "build", "example", "version", "id", "file", "image", "http", "card", "account", "phone", "order", "isbn")
DICTIONARY = frozenset(
    "the and ing ion ent tion for her ter hat tha ere ate his con res ver all ons nce men ith ted ers pro thi wit are ess not ive was ect rea com eve per int est sta cti ica ist ear ain one our iti rat ell "
    "sch ein ich die der und den cht ung gen ver ber ten que ent les des ait ous est par eur ado cia men ara con nte aci".split()
)
KINDS = ("pem", "aws", "forge", "chat", "jwt", "general", "assigned", "login")
# A password between a user name and a host.
LOGIN = re.compile(r"""://[^\s/?#@:"'<>]{0,64}:(?P<login>[^\s/?#@"'<>]{3,128})@(?=[0-9A-Za-z\[])""")
UNKNOWN_FORMATS = ("general", "assigned")
BEHIND_SIGNS = ("assigned", "login")
# What follows = or :, in quotes or up to a blank or bracket; and the secret word that must stand before the sign.
ASSIGNED = re.compile(r"""(?::=|=>|={1,3}|:)\s{0,3}(?:[!*|]{1,3}\s{1,3})?(?:"(?P<double>[^"\s]{6,})"|'(?P<single>[^'\s]{6,})'|`(?P<back>[^`\s]{6,})`|(?P<bare>[^\s"'`,;&<>()\[\]{}=:][^\s"'`,;&<>()\[\]{}]{5,}))""")
ASSIGNS = re.compile(rf"(?<![a-z])(?:{'|'.join(map(re.escape, SECRET_WORDS))})s?[0-9]{{0,2}}[\s!*|\"'`\]]{{0,6}}$")
FEATURES = ("length", "digits", "upper", "lower", "other", "kinds", "class_changes", "repeats", "entropy", "hex", "covered", "path", "secret_word", "other_word", "assigned", "quoted", "known_format")
AROUND = 40
TREES, DEPTH = 40, 7


def _lowered(before: str) -> str:
    """Lower case, with a mark between the parts of camelCase names."""
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "_", before).lower()


def candidates_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each candidate, in order. An assigned value may hold or cut general ones, but no known format."""
    out = [(m.start(), m.end(), m.lastgroup) for m in CANDIDATE.finditer(text)]
    more, at = [], 0
    for m in ASSIGNED.finditer(text):
        if not ASSIGNS.search(_lowered(text[max(0, m.start() - AROUND) : m.start()])):
            continue
        lo, hi = m.span(m.lastgroup)
        while m.lastgroup == "bare" and hi > lo and text[hi - 1] in ".!?:":  # a sentence's end
            hi -= 1
        while at < len(out) and out[at][1] <= lo:
            at += 1
        met = out[at : bisect_left(out, (hi,), lo=at)]
        if hi - lo >= 6 and all(kind == "general" and (a, b) != (lo, hi) for a, b, kind in met):
            more.append((lo, hi, "assigned"))
    if "://" in text:
        more += [(*m.span("login"), "login") for m in LOGIN.finditer(text)]
    return sorted(out + more) if more else out


def features_of(text: str, start: int, end: int, kind: str) -> list[float]:
    """FEATURES of the candidate text[start:end]."""
    s = text[start:end]
    n = len(s)
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in s]
    counts = np.unique(list(s), return_counts=True)[1] / n
    low = s.lower()
    covered = np.zeros(n, bool)
    for i in range(n - 2):
        if low[i : i + 3] in DICTIONARY:
            covered[i : i + 3] = True
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    near = _lowered(before)
    line = before.rpartition("\n")[2].split(" ")[-1]
    has = lambda words: float(any(re.search(rf"(?<![a-z]){re.escape(w)}s?(?![a-z])", near) for w in words))
    return [
        min(n, 200), classes.count("d") / n, classes.count("u") / n, classes.count("l") / n, classes.count("o") / n, len(set(classes)),
        sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / n, sum(a == b for a, b in zip(s, s[1:], strict=False)) / n,
        float(-(counts * np.log2(counts)).sum()), float(all(c in "0123456789abcdefABCDEF" for c in s)), covered.mean(),
        float(s.count("/") >= 2 or "://" in line or "/" in line or after[:1] in ("/", ".")), has(SECRET_WORDS), has(OTHER_WORDS),
        float(bool(re.search(r"[=:]\W{0,6}$", before))), float(before[-1:] in ("\"", "'", "`")), float(kind not in UNKNOWN_FORMATS),
    ]


def labelled_texts(n: int = 3600, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, is a secret) of ``n`` labelled findings and a sixth as many of short passwords."""
    rng = np.random.default_rng(seed)
    hexes, alnum = "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    draw = lambda chars, k: "".join(rng.choice(list(chars), k))
    parts = sorted(DICTIONARY)
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 4)))
    prose = lambda: " ".join(word() for _ in range(rng.integers(2, 7)))
    marks = list("!@#$%^*?.~-_+")
    out = []
    for i in range(n):
        true = i % 2
        if i % 6 >= 4:  # short, punctuated or digit-free values behind a secret word and a sign
            lead = rng.choice(["token", "secret", "password", "PASSWORD", "passwd", "pwd", "DB_PASSWORD", "dbPassword", "api_key", "auth_token", "credential", "client_secret"])
            join = rng.choice(["=", " = ", ": ", ":", " = \"", "=\"", ": \"", "='", " := \"", "\": \""])
            title = word().title()
            if true:
                value = [
                    draw(alnum, rng.integers(10, 20)), draw(alnum[10:], rng.integers(16, 40)), title + draw("0123456789", rng.integers(2, 5)) + rng.choice(marks), draw(alnum + "!@#$%^*?~+", rng.integers(8, 24)),
                    title[0] + "4" + title[1:] + rng.choice(marks) + draw("0123456789", 2) + word(), word().title() + rng.choice(marks) + title + draw("0123456789", rng.integers(1, 4)), draw(alnum, rng.integers(8, 14)) + rng.choice(marks) + draw(alnum, rng.integers(4, 10)),
                    word() + word() + draw("0123456789", rng.integers(1, 5)),
                ][rng.integers(8)]
                value += draw("0123456789", 2) if len(value) < 8 else ""
                value = "x" + value if value[-1] in ".!?:" and not join.endswith(("\"", "'")) else value
                value = value.rstrip(".!?:") if not join.endswith(("\"", "'")) else value
                value += draw(alnum, max(0, 8 - len(value)))
            else:
                value = [
                    word() + word(), word() + word() + rng.choice(["()", ".", ","]), "_".join(word() for _ in range(3)), ".".join(word() for _ in range(3)), "-".join(word() for _ in range(2)) + "-" + word(), title + word(), "$" + word().upper() + "_" + word().upper(), "*" * int(rng.integers(6, 12)),
                    "xxxxxxxx"[: int(rng.integers(6, 9))], "changeme", "required", "optional", "https://" + word() + ".org/" + word(), "/" + word() + "/" + word() + "/" + word(), "undefined", draw("0123456789", 6), word() + "_" + word() + ".get_" + word(), "process.env." + word().upper(), "String", "string", "self." + word() + word(),
                ][rng.integers(21)]
                value = value if len(value) >= 6 else value + word() + "es"
        elif true:
            value = [draw(hexes, rng.choice([32, 40, 64])), draw(alnum, rng.integers(20, 44)), draw(alnum + "+/", 40), draw(alnum + "_-", rng.integers(24, 64)), "AKIA" + draw(alnum[:36], 16), "ghp_" + draw(alnum, 36)][rng.integers(6)]
            lead = rng.choice(["token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private key", "bearer"])
            join = rng.choice([" = \"", "=", ": ", " = '", ": \"", " ", ' := "', "=\"", "!! =!! \"", "*** =*** \"", " | = | \""])
            if rng.random() < 0.15 and (value.startswith("AKIA") or value.startswith("ghp_")):
                lead, join = word(), " "
        else:
            kind = rng.integers(9)
            value = [
                draw(hexes, rng.choice([32, 40, 64])), f"{draw(hexes, 8)}-{draw(hexes, 4)}-{draw(hexes, 4)}-{draw(hexes, 4)}-{draw(hexes, 12)}", draw("0123456789", rng.integers(16, 24)),
                "/".join(word() for _ in range(4)) + "/" + draw("0123456789", 3), "_".join(word() for _ in range(4)) + draw("0123456789", 2), word() + word() + word() + word() + draw("0123456789", 2),
                "x" * 16 + "0" * int(rng.integers(1, 8)), "your_" + rng.choice(["token", "api_key", "password"]) + "_here_123", "0123456789" * int(rng.integers(2, 4)),
            ][kind]
            lead = rng.choice(["token", "password", "key"]) if kind >= 6 or (kind in (4, 5) and rng.random() < 0.2) else rng.choice(["sha1", "md5", "commit", "checksum", "uuid", "file", "id", "card", "build", word(), word()])
            join = rng.choice([" ", ": ", " = ", "=", " \"", "!! "])
        if i % 6 < 4 and rng.random() < 0.3:
            value, lead = (value.upper(), lead.upper()) if rng.random() < 0.3 and not value.startswith(("ghp_", "AKIA")) else (value, lead)
        text = f"{prose()} {lead}{join}"
        start = len(text)
        closing = join[-1] if join[-1] in "\"'" else ""
        text += f"{value}{closing} {prose()}"
        out.append((text, start, start + len(value), true))
    for i in range(n // 6):  # passwords in URLs, and short plain ones behind a secret word
        true, base = i % 2, word()[:7] + "er"
        short = [base + draw("0123456789", rng.integers(1, 4)) + rng.choice(marks), base + rng.choice(marks) + draw("0123456789", 3), base[0] + "3" + base[1:] + draw("0123456789", 2), rng.choice(marks) + base.title() + draw("0123456789", 2)][rng.integers(4)]
        if i % 6 >= 4:
            lead = f"https://{word()}.org/{word()}?" + rng.choice(["access_token=", "token=", "api_key=", "key=", "auth="] if true else ["id=", "v=", "build=", "sha=", "file="])
            value, ends = [draw(hexes, rng.choice([32, 40])), draw(alnum, rng.integers(20, 44))][rng.integers(2)], rng.choice(["&page=2", "", "&ref=" + word()])
        elif i % 6 < 2:
            value = [base + draw("0123456789", rng.integers(1, 4)), short, draw(alnum, rng.integers(8, 21)), draw(alnum + "!$%^*~-_", rng.integers(8, 21))][rng.integers(4)]
            names = ["password", "pass", "passwd", "pwd", "secret", "pw", "user", "token", "x" * int(rng.integers(3, 9)), "*" * int(rng.integers(3, 9)), "%s", "...", "changeme"]
            false = [rng.choice(names), "$" + word().upper() + "_PASS", "${" + word().upper() + "_PASSWORD}", "{" + rng.choice(names[:6]) + "}", "[" + rng.choice(names[:6]) + "]", rng.choice(names[:6]).upper(), "your-" + rng.choice(names[:4]), draw("0123456789", 4)][rng.integers(8)]
            lead = f"{rng.choice(['postgres', 'mysql', 'mongodb', 'redis', 'amqp', 'ftp', 'https', 'http'])}://{word()[:rng.integers(1, 9)]}:"
            value, ends = (value if true else str(false)), f"@{word()}.{rng.choice(['org', 'local', 'internal:5432'])}/{word()}"
        else:
            lead = rng.choice(["password", "pwd", "passwd", "secret", "DB_PASSWORD"]) + rng.choice([' = "', '="', ': "', "='"])
            value, ends = (short if true else str(rng.choice([base + "es", base + " " + base, "<" + base + ">", base.upper() + "_KEY", "get_" + base + "()", "placeholder", base + "." + base]))), lead[-1]
        text = f"{prose()} {lead}"
        out.append((f"{text}{value}{ends} {prose()}", len(text), len(text) + len(value), true))
    return out


def labelled_findings(n: int = 3600, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(features, is a secret) of ``n`` labelled findings."""
    drawn = labelled_texts(n, seed)
    kinds = ["aws" if t.startswith("AKIA", lo) else "forge" if t.startswith("ghp_", lo) else "login" if re.search(r"://[^\s/]*:$", t[:lo]) else "general" for t, lo, _, _ in drawn]
    return np.array([features_of(t, lo, hi, k) for (t, lo, hi, _), k in zip(drawn, kinds, strict=True)]), np.array([true for *_, true in drawn])


class Forest:
    """Random forest of Gini trees on bootstrap samples, each split over a random half of the features."""

    def __init__(self, trees: list[list[np.ndarray]]) -> None:
        self.trees = trees

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> Forest:
        rng = np.random.default_rng(seed)
        return Forest([Forest._tree(x[i], y[i], depth, rng) for i in (rng.integers(0, len(x), len(x)) for _ in range(trees))])

    @staticmethod
    def _tree(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> list[np.ndarray]:
        feature, cut, left, right, share = [], [], [], [], []

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(feature)
            for a in (feature, cut, left, right):
                a.append(-1)
            share.append(y[rows].mean())
            if level == depth or len(rows) < 8 or share[at] in (0.0, 1.0):
                return at
            best = (np.inf, -1, 0.0)
            for f in rng.choice(x.shape[1], x.shape[1] // 2, replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, ones = x[rows[order], f], np.cumsum(y[rows[order]])
                k = np.flatnonzero(v[1:] > v[:-1]) + 1
                if not len(k):
                    continue
                a, b, n = ones[k - 1], ones[-1] - ones[k - 1], len(rows)
                gini = k - (a**2 + (k - a) ** 2) / k + (n - k) - (b**2 + (n - k - b) ** 2) / (n - k)
                j = gini.argmin()
                if gini[j] < best[0]:
                    best = (gini[j], f, (v[k[j]] + v[k[j] - 1]) / 2)
            if best[1] >= 0:
                feature[at], cut[at] = best[1], best[2]
                go = x[rows, best[1]] <= best[2]
                left[at] = grow(rows[go], level + 1)
                right[at] = grow(rows[~go], level + 1)
            return at

        grow(np.arange(len(x)), 0)
        return [np.array(feature), np.array(cut, float), np.array(left), np.array(right), np.array(share)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = feature[at] >= 0
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


@lru_cache(maxsize=1)
def trained_forest() -> Forest:
    return Forest.fit(*labelled_findings())


def scan(texts: list[str | None], forest: Forest, cut: float = 0.5) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, kind, score) of each candidate of each whole text, in order.

    Of findings that overlap, secrets come before others, then assigned values before general ones.
    """
    spots, rows = [], []
    for i, t in enumerate(texts):
        for lo, hi, kind in candidates_of(t or ""):
            spots.append((i, lo, hi, kind))
            rows.append([1.0] * len(FEATURES) if kind == "pem" else features_of(t, lo, hi, kind))
    scores = forest.predict(np.array(rows)) if rows else []
    out: list[list] = [[] for _ in texts]
    for (i, lo, hi, kind), p in zip(spots, scores, strict=True):
        out[i].append((lo, hi, kind, 1.0 if kind == "pem" else float(p)))
    return [_parted(found, cut) if any(f[2] in BEHIND_SIGNS for f in found) else found for found in out]


def _parted(found: list[tuple[int, int, str, float]], cut: float) -> list[tuple[int, int, str, float]]:
    """Findings in order without overlaps of assigned values with general candidates or each other."""
    kept: list[tuple[int, int, str, float]] = []
    for f in sorted(found, key=lambda f: (f[3] >= cut, f[2] in BEHIND_SIGNS, f[3]), reverse=True):
        at = bisect_left(kept, f)
        if (at == 0 or kept[at - 1][1] <= f[0]) and (at == len(kept) or kept[at][0] >= f[1]):
            kept.insert(at, f)
    return kept


FINDINGS = "doc_id long, start int, end int, kind string, score double, is_secret boolean"


def find_secrets(docs: DataFrame, forest: Forest | None = None, cut: float = 0.5) -> DataFrame:
    """One row for each candidate of each whole text: (doc_id, start, end, kind, score, is_secret); offsets count code points.

    Null and empty texts have no candidates; rows that repeat a document repeat its findings; a
    null doc_id stays null. Columns other than doc_id and text are ignored, and an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest or trained_forest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = scan(b.column("text").to_pylist(), shared.value)
            rows = [(d, lo, hi, k, p, p >= cut) for d, f in zip(b.column("doc_id").to_pylist(), found, strict=True) for lo, hi, k, p in f]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "start", "end", "kind", "score", "is_secret"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FINDINGS)


MASK = "[SECRET]"


def redact_secrets(docs: DataFrame, forest: Forest | None = None, cut: float = 0.5) -> DataFrame:
    """``docs`` with each secret in text replaced by a mark; n_chars, where there is such a column, counts the new text. All rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(forest or trained_forest())
    columns, spot = docs.columns, docs.columns.index("text")
    counted = columns.index("n_chars") if "n_chars" in columns else None
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(spot).to_pylist()
            changed = {}
            for i, found in enumerate(scan(texts, shared.value)):
                out, at = [], 0
                for lo, hi, _, p in found:
                    if p >= cut:
                        out += [texts[i][at:lo], MASK]
                        at = hi
                if out:
                    changed[i] = "".join(out) + texts[i][at:]
            if changed:
                cols = list(b.columns)
                for i, t in changed.items():
                    texts[i] = t
                cols[spot] = pa.array(texts, cols[spot].type)
                if counted is not None:
                    n = cols[counted].to_pylist()
                    for i, t in changed.items():
                        n[i] = len(t)
                    cols[counted] = pa.array(n, cols[counted].type)
                b = pa.RecordBatch.from_arrays(cols, names=b.schema.names)
            yield b

    return docs.select(columns).mapInArrow(run, schema)
