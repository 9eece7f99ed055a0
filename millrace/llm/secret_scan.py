"""Secret scans: wide candidate patterns, and a random forest that removes false positives.

Candidates are tokens of 12 key-like characters or more with a digit, and all values, quoted or not and of any characters and
length, assigned to a name with a key-like word in it. Both kinds are judged where they overlap; of overlapping secrets the
longest is reported. The forest sees their length, the transitions between characters (classes, repeats, how unlike words the letter pairs are), how much of them a
dictionary of common word pieces covers, the path the text came from, and the neighbouring words. It is trained from
labelled findings: ``train`` takes any (text, path, start, end, label); the default set is made by ``labelled_findings``, a seeded
generator of keys in the contexts where they leak, and of hashes, ids, words, numbers and placeholders that are none.

Null and empty texts have no findings; repeated rows give equal results; every candidate of a whole text is judged.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps, table, with_field, without

THRESHOLD = 0.5
CANDIDATE = re.compile(r"(?<![A-Za-z0-9_+/.\-@])(?:[A-Za-z_][A-Za-z_.\-]{1,40}\s?[=:]\s?[\"']?)?(?P<value>(?=[A-Za-z_+/.\-]*+\d)[A-Za-z0-9_+/.\-]{12,}={0,2})(?![\w@])")
KEYED = re.compile(
    r"(?:pass|pwd|secret|token|key|credential|auth|bearer|signature|jwt|session|cookie)[\w.\-]{0,40}+[\"']?\]?\s{0,3}(?:=>|:=|={1,3}|:)[^\S\r\n]{0,3}"
    r"(?:\"(?P<double>(?:[^\"\\\r\n]|\\.)++)\"|'(?P<single>(?:[^'\\\r\n]|\\.)++)'|[\"']?(?:(?:Bearer|Basic|Token) )?(?P<bare>(?:(?!&\w+=)[^\s\"'`,;])*(?!&\w+=)[^\s\"'`,;.:)\]}>]))",
    re.I,
)

# Words around keys, words around what looks like keys, path endings, and common word pieces.
LEAKY = set("key keys apikey api_key secret secrets token tokens password passwd pwd pass credential credentials auth authorization bearer private access client_secret access_key secret_key aws ssh jwt signature".split())
HARMLESS = set("commit sha sha1 sha256 md5 hash checksum digest uuid guid id version revision etag isbn order invoice tracking example sample dummy placeholder test card phone build".split())
CODE_ENDINGS = tuple(".py .js .ts .go .java .rb .php .sh .env .yml .yaml .json .toml .ini .cfg .conf .properties .tf .xml".split())
PIECES = "the and ing ion ent ati for her ter hat tha ere ate his con res ver all ons nce men ith ted ers pro thi wit are ess not ive was ect rea com eve per int est sta cti ica ist ear ain one our iti rat ell tion ment able ness word name user data file test example sample string value index number system server client page image".split()
PIECE = re.compile("|".join(sorted(PIECES, key=len, reverse=True)))
FORMATS = re.compile(r"AKIA[0-9A-Z]{16}$|ASIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_|xox[bpas]-|AIza[0-9A-Za-z_\-]{35}$|eyJ[A-Za-z0-9_\-]+\.|glpat-|SG\.")
PLACEHOLDER = re.compile(r"(?:none|null|nil|true|false|undefined|string|str|int|required|optional|hidden|redacted|todo|tbd|change.?me|x+|\*+|[<${\[%&].*|process\.env.*|os\.(?:environ|getenv).*|[\w.]+\(.*|.*(?:your|example|placeholder|dummy|sample|insert).*)", re.I)
WORDS = re.compile(r"[A-Za-z_]+")
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NAMES = [
    "length", "digits", "lower", "upper", "other", "entropy", "class changes", "repeats", "vowel rate", "longest letters", "letter pairs", "covered", "hex only", "digits only", "known format", "uuid form",
    "leaky word before", "harmless word before", "assigned", "quoted", "distance of leaky word", "code path", "words before", "upper and lower", "placeholder", "blanks",
]
VOWELS = set("aeiouAEIOUäöüéèêáíóú")


def _pair_rates() -> dict[str, float]:
    """How usual a letter pair is among the word pieces."""
    pairs = Counter(w[i : i + 2] for w in PIECES for i in range(len(w) - 1))
    total = sum(pairs.values())
    return {p: math.log((n + 0.1) / total) for p, n in pairs.items()}


PAIRS = _pair_rates()
RARE = math.log(0.1 / 300)


def kind_of(c: str) -> str:
    return "9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "-"


def features(text: str, start: int, end: int, path: str = "") -> list[float]:
    """One candidate as numbers, in the order of NAMES."""
    v, before, n = text[start:end], text[max(0, start - 80) : start], end - start
    kinds, counts, low = [kind_of(c) for c in v], Counter(v), v.lower()
    near_raw = WORDS.findall(before)[-5:]
    near = [w.lower() for w in near_raw]
    letters = [m for m in re.findall("[A-Za-z]+", v)]
    pairs = [low[i : i + 2] for i in range(n - 1) if low[i].isalpha() and low[i + 1].isalpha()]
    leaky = [k for k, w in enumerate(reversed(near_raw)) if w.lower() in LEAKY or any(p.lower() in LEAKY for p in CAMEL.findall(w))]
    share = lambda k: kinds.count(k) / n
    return [
        math.log(n), share("9"), share("a"), share("A"), share("-"), -sum(k / n * math.log2(k / n) for k in counts.values()), sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        sum(a == b for a, b in zip(v, v[1:])) / n, sum(c in VOWELS for c in v) / max(1, sum(map(len, letters))), max(map(len, letters), default=0) / n, sum(PAIRS.get(p, RARE) for p in pairs) / max(1, len(pairs)),
        sum(len(m[0]) for m in PIECE.finditer(low)) / n, float(all(c in string.hexdigits for c in v)), float(v.isdigit()), float(bool(FORMATS.match(v))), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", v))),
        float(bool(leaky)), float(any(w in HARMLESS for w in near[-3:])), float(bool(re.search(r"[=:]\s?[\"']?$", before))), float(before[-1:] in ("'", '"')), float(min(leaky, default=9)), float(path.lower().endswith(CODE_ENDINGS)),
        float(len(near)), float("a" in kinds and "A" in kinds), float(bool(PLACEHOLDER.fullmatch(v))), float(any(map(str.isspace, v))),
    ]


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Spans of all candidates, in order; values after a key-like name may hold or be tokens too."""
    if not text:
        return []
    return sorted({m.span("value") for m in CANDIDATE.finditer(text)} | {m.span(m.lastgroup) for m in KEYED.finditer(text)})


def outermost(found: list[dict]) -> list[dict]:
    """Of overlapping secrets the longest one (the first of equally long ones), in order."""
    kept: list[dict] = []
    for f in sorted(found, key=lambda f: (f["start"] - f["end"], f["start"])):
        if all(f["end"] <= k["start"] or k["end"] <= f["start"] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f["start"])


@dataclass
class Forest:
    """Trees as arrays: feature, limit, left, right, value; a leaf has feature -1."""

    trees: list[tuple[np.ndarray, ...]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, limit, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = np.where(x[rows, feature[node]] <= limit[node], left[node], right[node])
            out += value[at]
        return out / max(1, len(self.trees))


def _grow(x: np.ndarray, y: np.ndarray, r: np.random.Generator, depth: int, leaf: int) -> tuple[np.ndarray, ...]:
    nodes: list[list] = []

    def add(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        best = (1e-9, None)
        if level < depth and len(rows) >= 2 * leaf and 0 < nodes[me][4] < 1:
            base = nodes[me][4] * (1 - nodes[me][4]) * len(rows)
            for f in r.choice(x.shape[1], max(2, round(math.sqrt(x.shape[1]))), replace=False):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, ones = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(order))
                a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(order) - n)
                gain = base - a * (1 - a) * n - b * (1 - b) * (len(order) - n)
                gain[(v[1:] <= v[:-1]) | (n < leaf) | (len(order) - n < leaf)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (int(f), (v[k] + v[k + 1]) / 2, order[: k + 1], order[k + 1 :]))
        if best[1] is not None:
            f, limit, a, b = best[1]
            nodes[me][:2] = [f, limit]
            nodes[me][2], nodes[me][3] = add(a, level + 1), add(b, level + 1)
        return me

    add(np.arange(len(y)), 0)
    return tuple(np.array([n[i] for n in nodes], t) for i, t in enumerate((np.int64, float, np.int64, np.int64, float)))


def train(findings: list[tuple[str, str, int, int, int]], trees: int = 40, depth: int = 10, seed: int = 0) -> Forest:
    """A forest from labelled findings (text, path, start, end, label); without findings nothing is a secret."""
    if not findings:
        return Forest([])
    x, y = np.array([features(t, a, b, p) for t, p, a, b, _ in findings]), np.array([f[4] for f in findings], float)
    r = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = r.integers(0, len(y), len(y))
        out.append(_grow(x[rows], y[rows], r, depth, 3))
    return Forest(out)


def labelled_findings(n: int = 3000, seed: int = 7) -> list[tuple[str, str, int, int, int]]:
    """Keys where keys leak, and look-alikes that are none; half of each label in prose, half in code."""
    r, out = random.Random(seed), []
    of = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexs, b64 = "0123456789abcdef", string.ascii_letters + string.digits
    word = lambda: "".join(r.choice(PIECES) for _ in range(r.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))

    def made_up(quoted: bool) -> str:
        """A password as people choose them; without quotes it has digits or signs."""
        k = r.randrange(5 if quoted else 3)
        if k < 3:
            base = word() if r.random() < 0.5 else of(string.ascii_lowercase, r.randint(3, 9))
            return (base.capitalize() if r.random() < 0.4 else base) + of(string.digits, r.randint(1, 6)) + of("!@#$%&*?", k)
        return word() + word() + word() if k == 3 else of(string.ascii_letters, r.randint(8, 24))

    for i in range(n):
        q, eq = r.choice(["", '"', "'"]), r.choice(["=", " = ", ": ", ":"])
        if i % 2:
            shape = r.randrange(8)
            key = [lambda: "AKIA" + of(string.ascii_uppercase + string.digits, 16), lambda: of(hexs, r.choice([16, 18, 24, 32, 40, 64])), lambda: of(b64, r.randint(16, 48)), lambda: "ghp_" + of(b64, 36), lambda: "sk_live_" + of(b64, 24), lambda: of(b64 + "+/", 40), lambda: made_up(bool(q)), lambda: "eyJ" + of(b64 + "-_", r.randint(60, 1500)) + r.choice(["", "." + of(b64 + "-_", 43)])][shape]()
            bare = shape in (0, 3, 4) and r.random() < 0.6
            lead = "" if bare else r.choice(["token", "password", "secret", "api_key", "access_key", "auth_token", "client_secret", "passwd", "private_key", "pwd"]) + eq + q
            label = 1
        else:
            shape = r.randrange(13)
            key = [
                lambda: of(hexs, 40), lambda: of(hexs, 64), lambda: "-".join(of(hexs, k) for k in (8, 4, 4, 4, 12)), lambda: of(string.digits, r.randint(12, 19)), lambda: word() + word() + str(r.randint(1, 9999)) + word(),
                lambda: "your-api-key-" + str(r.randint(1, 99)), lambda: "x" * r.randint(10, 20) + "1234", lambda: f"{word()}_{word()}_v{r.randint(1, 9)}.{r.choice(['png', 'html', 'tar.gz'])}", lambda: f"{r.randint(1, 255)}.{r.randint(10, 255)}.{r.randint(10, 255)}.{r.randint(1, 255)}", lambda: f"20{r.randint(10, 30)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T10:00",
                lambda: r.choice(["None", "null", "true", "changeme", "********", "<token>", "${PASSWORD}", "string", "required", "your-password", "example", f"get_{word()}()", f"os.environ[{word()}]", f"{word()}.{word()}" if not q else "xxxxxx"]), lambda: word() if not q else prose(r.randint(3, 9)), lambda: of(b64 + "+/", r.randint(100, 1500)),
            ][shape]().replace(":", "-")
            lead = r.choice(["commit ", "sha256: ", "id=", "uuid: ", "version ", "checksum " + q, "", "", "order ", "see "]) if shape not in (5, 10, 11, 12) else r.choice(["data:image/png;base64,", "content: ", "body=" + q]) if shape == 12 else r.choice(["the key", "a token", "his secret", "password", "session", "author"]) + ": " + q if shape == 11 else r.choice(["api_key", "token", "password"]) + eq + q
            label = 0
        code = r.random() < 0.5
        left = prose(r.randint(0, 8)) + r.choice([" ", "\n", "; "])
        text = left + lead + key + (q if lead.endswith(q) else "") + " " + prose(r.randint(0, 5))
        start = len(left) + len(lead)
        out.append((text, word() + r.choice(CODE_ENDINGS) if code else r.choice(["", "src1", "page.html", "notes.txt"]), start, start + len(key), label))
    return out


FOUND = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def scan(df: DataFrame, forest: Forest, text: str = "text", path: str | None = None, output: str = "secrets", total: str = "n_candidates") -> DataFrame:
    """Add ``output`` (spans and scores of the secrets) and ``total`` (how many candidates were judged) for every whole text."""
    df = without(df, output, total)
    at, where = df.columns.index(text), df.columns.index(path) if path else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, at):
                rows, owner, spans = [], [], []
                paths = part.column(where).to_pylist() if where is not None else [""] * len(part)
                for i, t in enumerate(part.column(at)):
                    t = t.as_py()
                    for a, b in candidates(t):
                        rows.append(features(t, a, b, str(paths[i] or "")))
                        owner.append(i)
                        spans.append((a, b))
                found, judged = [[] for _ in range(len(part))], [0] * len(part)
                for i, (a, b), p in zip(owner, spans, forest.predict(np.array(rows)) if rows else []):
                    judged[i] += 1
                    if p >= THRESHOLD:
                        found[i].append({"start": a, "end": b, "score": float(p)})
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([outermost(f) if len(f) > 1 else f for f in found], kind), pa.array(judged, pa.int64())], [*part.schema.names, output, total])

    return df.mapInArrow(run, with_field(df.schema, T.StructField(output, FOUND), T.StructField(total, T.LongType())))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = scan(docs, train(labelled_findings()), path="source")
    return out.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), "secrets")
