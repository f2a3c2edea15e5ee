"""Secret scans: patterns find candidates, a random forest removes the false positives.

Candidates are all runs of 16 or more characters of keys, and values assigned to a word like ``password``, which are sought
after every colon and equals sign. The forest alone judges them. It sees a candidate's length, its character transitions, how much of it common words cover, whether it stands in a path or address,
and the words beside it. It is trained from labelled findings: (text, start, end, label) with offsets in UTF-8 bytes.

Null and empty texts have no candidates. Repeated rows are scanned each for itself. Equal texts give equal findings; of two
overlapping candidates the longer counts, of equally long ones the first. Very long texts and runs are scanned whole. An
empty table has no findings (and trains on one made word). ``findings`` reads id and text only; ``redact`` keeps further
columns whatever they are called.
"""

from __future__ import annotations

import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqstats.llm.common import map_batches, utf8
from seqstats.session import written

#: The dictionary's size: so many words of all documents, the most common ones.
DICTIONARY_WORDS = 20_000
FINDINGS = 8_000
THRESHOLD = 0.5
MASK = b"[SECRET]"

WORDS = re.compile(rb"[a-z\x80-\xff]{2,}")
RUN = re.compile(rb"[A-Za-z0-9+/_\-.~]{16,}={0,2}")
#: What stands before a value, and a value. Values may hold further places, so a place ends where its value begins.
ASSIGNED = re.compile(rb"[:=]\s{0,3}[\"'`]?(?=[^\s\"'`<>,;]{6})")
VALUE = re.compile(rb"[^\s\"'`<>,;]*")
#: The name of a parameter in an address; its value ends where the next one or the fragment begins.
PARAMETER = re.compile(rb"[?&][\w\-.\[\]%]*$")
PARAMETER_END = re.compile(rb"[&#]")
#: Words that announce a secret, and words that announce a digest or an id.
ANNOUNCING = re.compile(rb"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|credential|bearer)")
BEFORE_VALUE = re.compile(ANNOUNCING.pattern + rb"[\w\-]{0,12}[\"'\s]{0,3}$")
HARMLESS = re.compile(rb"(?i)(sha-?\d*|md5|commit|checksum|digest|hash|uuid|isbn|id|version|build|revision|etag)\W*$")
KNOWN_START = re.compile(rb"(AKIA|ASIA|gh[pousr]_|sk_live_|sk-|xox[abp]-|AIza|eyJ|glpat-)")
PLACEHOLDER = re.compile(rb"(?i)(x{4,}|\*{3,}|example|change_?me|your[_-]|placeholder|required|null|none|true|false|undefined|\$\{|%\()")


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of candidates, in order, none over another."""
    found = set()
    for m in RUN.finditer(text):
        start, end = m.span()
        while text[end - 1 : end] in (b".", b"-", b"~"):
            end -= 1
        if end - start < 16:
            continue
        found.add((start, end))
    whole = stop = 0  # where the value and the parameter last seen end; the places inside them share that end
    outer = None
    for m in ASSIGNED.finditer(text):
        before = text[max(0, m.start() - 24) : m.start()]
        if BEFORE_VALUE.search(before):
            start = m.end()
            if start >= whole:
                whole, outer = VALUE.match(text, start).end(), None
            end = whole
            if name := PARAMETER.search(before):
                if start > stop or stop > whole:
                    mark = PARAMETER_END.search(text, start, whole)
                    stop = mark.start() if mark else whole
                end = stop
                begin = m.start() - len(before) + name.start()
                if outer and begin - outer[0] >= 6 and outer[1] > begin:  # a value that holds the parameter ends before it
                    found.discard(outer)
                    found.add((outer[0], begin))
            if end - start < 6:
                continue
            while end - start > 6 and text[end - 1 : end] in b".!?)]}|#$%&*":
                end -= 1
            outer = (start, end)
            found.add(outer)
    kept: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if kept and kept[-1][1] > start:
            if end - start > kept[-1][1] - kept[-1][0]:
                kept[-1] = (start, end)
        else:
            kept.append((start, end))
    return kept


def character_class(data: np.ndarray) -> np.ndarray:
    """0 digits, 1 lower case, 2 upper case, 3 others."""
    out = np.full(len(data), 3)
    out[(data >= 48) & (data <= 57)] = 0
    out[(data >= 97) & (data <= 122)] = 1
    out[(data >= 65) & (data <= 90)] = 2
    return out


@dataclass
class Language:
    """Common words, and log probabilities of neighbouring characters in ordinary words."""

    words: frozenset[bytes]
    pairs: np.ndarray
    #: Lengths of words, the longest first.
    sizes: tuple[int, ...] = ()

    def __post_init__(self):
        self.sizes = tuple(sorted({len(w) for w in self.words if len(w) > 2}, reverse=True))

    def covered(self, part: bytes) -> int:
        """How many bytes words of the dictionary cover, the longest that fits at each place first."""
        at = covered = 0
        while at + 3 <= len(part):
            size = next((n for n in self.sizes if n <= len(part) - at and part[at : at + n] in self.words), 0)
            covered += size
            at += size or 1
        return covered

    @classmethod
    def of(cls, texts: list[bytes], size: int = DICTIONARY_WORDS) -> Language:
        counts = Counter(w for t in texts for w in WORDS.findall(t.lower()))
        common = sorted(counts, key=lambda w: (-counts[w], w))[:size]
        return cls.made(common, transitions(list(counts), np.fromiter(counts.values(), np.int64, len(counts))))

    @classmethod
    def made(cls, words: list[bytes], counts: np.ndarray) -> Language:
        pairs = counts.reshape(256, 256) + 0.05
        return cls(frozenset(words), np.log(pairs / pairs.sum(axis=1, keepdims=True)))


def transitions(words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """How often each of the 65,536 pairs of neighbouring characters occurs; a word's pairs weigh 20 at most."""
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    inner = np.ones(len(data), bool)
    inner[np.cumsum(sizes) - 1] = False
    at = np.flatnonzero(inner)
    return np.bincount(data[at] * 256 + data[at + 1], np.repeat(np.minimum(counts, 20), sizes)[at], 1 << 16)


def learned(documents: DataFrame, size: int = DICTIONARY_WORDS) -> Language:
    """``Language.of`` all texts. Words and pairs are counted in Spark; the driver gets ``size`` words and 65,536 pairs at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for text in utf8(batch.column(0)):
                counts.update(m[0] for m in WORDS.finditer(text.lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16)
        for batch in batches:
            total += transitions(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen].astype(np.int64))], names=["pair", "n"])

    counted = map_batches(documents.select("text"), count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counted = written(counted, "words")
    common = [bytes(r.word) for r in counted.orderBy(F.desc("n"), "word").limit(size).collect()]
    counts = np.zeros(1 << 16)
    for r in map_batches(counted, pair, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r.pair] = r.n
    return Language.made(common, counts)


def features(text: bytes, start: int, end: int, language: Language) -> list[float]:
    """What the forest sees of a candidate."""
    value = text[start:end]
    data = np.frombuffer(value, np.uint8)
    kinds = character_class(data)
    n = len(data)
    share = np.bincount(kinds, minlength=4) / n
    counts = np.bincount(data, minlength=256)
    counts = counts[counts > 0] / n
    lower = np.frombuffer(value.lower(), np.uint8)
    likely = float(language.pairs[lower[:-1], lower[1:]].mean()) if n > 1 else 0.0
    # words of letters inside the candidate, and what of them the dictionary covers (the longest words first)
    parts = re.findall(rb"[a-z\x80-\xff]{3,}", re.sub(rb"(?<=[a-z])(?=[A-Z])", b" ", value).lower())
    covered = sum(map(language.covered, parts))
    before, after = text[max(0, start - 40) : start], text[end : end + 16]
    words = before.split()
    near = b" ".join(words[-3:])
    last = before[-1:] if before else b" "
    return [
        np.log2(n), share[0], share[1], share[2], share[3], float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0,
        float(-(counts * np.log2(counts)).sum()), len(counts) / n, likely, covered / n,
        float(bool(re.fullmatch(rb"[0-9a-fA-F]+", value))), float(value.isdigit()), float(bool(KNOWN_START.match(value))),
        float(value.count(b"/") + value.count(b".")) / n * 16, float(bool(re.search(rb"\.[a-z]{2,5}$", value))),
        float(b"://" in before[-12:] or b"@" in before[-2:] or after[:1] == b"@"), float(last in b"/\\."), float(last in b"\"'`=:"),
        float(bool(ANNOUNCING.search(near))), float(bool(HARMLESS.search(before[-16:]))), float(bool(PLACEHOLDER.search(value))),
        float(after[:1] in b"\"'`"), float(value[:8].count(b"-") + value.count(b"-") > 2),
    ]


@dataclass
class Forest:
    """Trees as node arrays, one row per tree; a leaf's children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The trees' mean share of secrets."""
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.value[node].mean(axis=1)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 2, seed: int = 11) -> Forest:
    """Trees on bootstrap samples; every split sees a random subset of the features and has the least Gini impurity."""
    draw = np.random.default_rng(seed)
    nodes: list[list[float]] = []
    roots = []
    tried = max(2, int(np.sqrt(x.shape[1])) + 1)

    def grow(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        ones = y[rows].sum()
        nodes.append([0, np.inf, at, at, float(ones / len(rows)) if len(rows) else 0.5])
        if level == depth or len(rows) < 2 * least or ones in (0, len(rows)):
            return at
        best = (np.inf, 0, 0.0)
        for j in draw.choice(x.shape[1], tried, replace=False):
            order = np.argsort(x[rows, j], kind="stable")
            v, t = x[rows, j][order], y[rows][order]
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            cut = cut[(cut >= least) & (cut <= len(rows) - least)]
            if not len(cut):
                continue
            left = np.cumsum(t)[cut - 1]
            right = ones - left
            impurity = left * (1 - left / cut) + right * (1 - right / (len(rows) - cut))
            k = int(np.argmin(impurity))
            if impurity[k] < best[0]:
                best = (impurity[k], j, (v[cut[k] - 1] + v[cut[k]]) / 2)
        if best[0] < ones * (1 - ones / len(rows)) - 1e-12:
            _, j, threshold = best
            goes = x[rows, j] <= threshold
            nodes[at][:2] = [j, threshold]
            nodes[at][2] = grow(rows[goes], level + 1)
            nodes[at][3] = grow(rows[~goes], level + 1)
        return at

    for _ in range(trees):
        roots.append(grow(draw.integers(0, len(y), len(y)), 0))
    a = np.array(nodes)
    return Forest(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots), depth)


def labelled_findings(words: list[str], size: int = FINDINGS, seed: int = 5) -> list[tuple[bytes, int, int, int]]:
    """Findings with known labels: made secrets and made harmless strings between words of ordinary text."""
    draw = random.Random(seed)
    words = words or ["word"]

    def of(alphabet: str, least: int, most: int | None = None) -> str:
        return "".join(draw.choice(alphabet) for _ in range(draw.randint(least, most or least)))

    letters, upper, hexes = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef"
    announcing = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret", "SECRET_KEY"]
    pick = draw.choice
    cases = [str.lower, str.upper, str.capitalize]
    long = sorted(words, key=lambda w: (-len(w), w))[: max(1, len(words) // 100)]

    def assigned(value: str) -> tuple[str, str, str]:
        quote = pick(["", "", '"', "'"])
        return f"{pick(announcing)}{pick(['=', ' = ', ': ', ':'])}{quote}", value, quote

    secrets = [
        lambda: assigned(of(hexes, 16, 64)),
        lambda: assigned(of(letters, 12, 48)),
        lambda: assigned(of(letters + "+/", 30, 64)),
        lambda: assigned(of(letters + "!@#%^-_", 9, 20)),
        lambda: ("", "AKIA" + of(upper, 16), ""),
        lambda: (pick(["", "key ", "aws "]), "ASIA" + of(upper, 16), ""),
        lambda: ("", pick(["ghp_", "gho_", "ghs_"]) + of(letters, 36), ""),
        lambda: ("", pick(["sk_live_", "sk-"]) + of(letters, 24, 48), ""),
        lambda: ("", f"xoxb-{of(string.digits, 11)}-{of(letters, 24)}", ""),
        lambda: ("", "AIza" + of(letters + "-_", 35), ""),
        lambda: (pick(["", "Bearer "]), f"eyJ{of(letters, 20, 40)}.eyJ{of(letters, 30, 80)}.{of(letters + '-_', 43)}", ""),
        lambda: (f"{pick(announcing)} ", of(letters, 24, 44), ""),
        lambda: (pick(["", "", f"{pick(announcing)} "]), of(pick([letters, string.ascii_letters]), 24, 48), ""),
    ]
    harmless = [
        lambda: ("", of(string.digits, 16), ""),
        lambda: (pick(["", "card ", "no. "]), of(string.digits, 16, 19), ""),
        lambda: (pick(["commit ", "sha256:", "md5 ", "checksum: ", "hash=", "etag: "]), of(hexes, pick([32, 40, 64])), ""),
        lambda: (pick(["uuid ", "id=", "id: ", ""]), "-".join(of(hexes, k) for k in (8, 4, 4, 4, 12)), ""),
        lambda: (pick(["/", "./", "src/", "http://"]), "/".join(pick(words) for _ in range(4)) + f"/{pick(words)}{draw.randint(0, 99)}.{pick(['js', 'py', 'html'])}", ""),
        lambda: ("https://", f"mail{draw.randint(0, 9)}.example.{pick(['com', 'org'])}/{pick(words)}/{draw.randint(0, 9999)}", ""),
        lambda: (f"{pick(words)}.{draw.randint(1, 99)}@", f"mail{draw.randint(0, 9)}.example.com", ""),
        lambda: ("", "-".join(pick(words) for _ in range(4)) + str(draw.randint(0, 99)), ""),
        lambda: ("", "".join(pick(words).capitalize() for _ in range(4)) + str(draw.randint(0, 9)), ""),
        lambda: ("", "_".join(pick(words) for _ in range(4)) + f"_{draw.randint(0, 9)}", ""),
        lambda: ("", f"20{of(string.digits, 2)}-0{draw.randint(1, 9)}-1{draw.randint(0, 9)}T12:00:00", ""),
        lambda: ("version ", f"{draw.randint(0, 9)}.{draw.randint(0, 99)}.{draw.randint(0, 999)}-beta.{draw.randint(0, 9)}", ""),
        lambda: (f"{pick(announcing)}{pick(['=', ': '])}", pick(["required", "undefined", "your_api_key_here", "xxxxxxxxxxxx", "${TOKEN}", "changeme", "example"]), ""),
        lambda: (f"{pick(announcing)}: ", pick(words) + pick(words) + pick(words), ""),
        lambda: ("", pick(cases)(pick(["-", "_", "/", ".", ""]).join(pick(words) for _ in range(draw.randint(3, 6)))), ""),
        lambda: ("", pick(cases)(pick(long) if pick([True, False]) else pick(words) + pick(words)), ""),
        lambda: ("", "".join(pick(words).capitalize() for _ in range(draw.randint(3, 6))), ""),
        lambda: ("", "/".join(pick(words) for _ in range(3)) + f".{pick(['js', 'py', 'html'])}", ""),
        lambda: ("", pick("-_.~+") * draw.randint(16, 60), ""),
    ]
    found = []
    for i in range(size):
        secret = i % 2
        lead, value, trail = pick(secrets if secret else harmless)()
        before = " ".join(pick(words) for _ in range(6)) + pick([" ", "\n", " "])
        after = pick([" ", ". ", "\n", "### ", ", "]) + " ".join(pick(words) for _ in range(3))
        start = len((before + lead).encode())
        found.append(((before + lead + value + trail + after).encode(), start, start + len(value.encode()), secret))
    return found


@dataclass
class Scanner:
    language: Language
    forest: Forest

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, float]]]:
        """Candidates of each text (start, end, score), all scored at once."""
        found = [(i, s, e) for i, t in enumerate(texts) for s, e in candidates(t)]
        out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        if found:
            x = np.array([features(texts[i], s, e, self.language) for i, s, e in found])
            for (i, s, e), score in zip(found, self.forest.score(x)):
                out[i].append((s, e, float(score)))
        return out


def trained(findings: list[tuple[bytes, int, int, int]], language: Language) -> Scanner:
    x = np.array([features(text, start, end, language) for text, start, end, _ in findings])
    return Scanner(language, fit(x, np.array([label for *_, label in findings], float)))


def train(documents: DataFrame) -> Scanner:
    """A scanner whose dictionary, transitions and findings come from the words of all documents."""
    language = learned(documents)
    words = sorted(w.decode() for w in language.words if w.isalpha())
    return trained(labelled_findings(words), language)


def findings(df: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per candidate: id, byte range, the forest's score and whether it is a secret."""
    shared = df.sparkSession.sparkContext.broadcast(scanner)
    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(i, *f) for i, found in zip(ids, model.scan(utf8(batch.column(1)))) for f in found]
            columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate((batch.column(0).type, pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start_byte", "end_byte", "score"])

    schema = f"doc_id {dict(source.dtypes)['doc_id']}, start_byte bigint, end_byte bigint, score double"
    return map_batches(source, run, schema).withColumn("secret", F.col("score") >= THRESHOLD)


def masked(text: bytes, found: list[tuple[int, int, float]]) -> bytes:
    at, parts = 0, []
    for start, end, score in found:
        if score >= THRESHOLD:
            parts += [text[at:start], MASK]
            at = end
    return b"".join([*parts, text[at:]])


def redact(docs: DataFrame, scanner: Scanner, text_col: str = "text") -> DataFrame:
    """The rows with every secret replaced by ``[SECRET]``; texts without one stay as they are, null too."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw = batch.column(at).cast(pa.binary()).to_pylist()
            found = model.scan([t or b"" for t in raw])
            texts = pa.array([t if t is None else masked(t, f) for t, f in zip(raw, found)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([texts if j == at else c for j, c in enumerate(batch.columns)], names=names)

    return map_batches(docs, run, docs.schema)
