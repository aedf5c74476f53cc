"""Secret scans: candidates by form, and a random forest that removes false findings.

A candidate is a run of 16 or more characters of keys (letters, digits, + / _ - . =) with a digit, or a value of six
or more signs, not counting punctuation at its end, that is assigned (= or :) to a name of a secret, a run of letters,
digits, _ . and - of any length. The forest (Breiman, "Random Forests", 2001; bootstrap
samples, a few random features a split, Gini impurity, in numpy) judges each candidate by its length, its character
classes and their transitions, the share of it that dictionary words cover, its likeness to paths, and the words
before and after. It is trained from labelled findings, a table that is a parameter; without one, from findings that
``example_findings`` makes from a seed.
"""

from __future__ import annotations

import math
import random
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.batches import text_slices
from scriptorium.llm.hashing import slices

LEAST, VALUE_LEAST = 16, 6
#: Bytes of context before and after a candidate that its features see.
CONTEXT = 64
#: Labelled findings that a forest is trained on.
ROWS = 20_000

#: Names of secrets, names of other long values, and words of paths and samples.
SECRET_NAMES = "token secret password passwd passphrase pwd apikey api_key access_key auth bearer credential private_key client_secret signature webhook".split()
OTHER_NAMES = "commit sha sha1 sha256 md5 checksum digest etag revision hash uuid guid id version build image blob tree serial order invoice isbn account card phone".split()
DICTIONARY = (
    "about account active address admin alpha application article asset backup batch before beta bin branch build business cache category center change "
    "chapter class client cloud code common company config content control copy count current customer data database debug default delta demo detail "
    "develop device directory document domain download draft dummy editor email engine entry error event example export feature file filter final folder "
    "format forum frame gallery general global graph group guide handler header height history home image import index info input install internal issue "
    "item key label language large layout library license light limit list local location login main manager master media member menu message method mobile "
    "model module monitor name network news number object office online option order output package page panel parent password path people photo placeholder "
    "plugin policy portal post preview price primary private process product profile program project public query random record region release report request "
    "resource result review sample schema script search section secret server service session setting share small source staging static status storage store "
    "style summary support system table target task template test theme thread title token tool total track update upload user value version video view web"
).split()

_SECRET_NAME = re.compile("|".join(SECRET_NAMES), re.I)
_OTHER_NAME = re.compile(r"\b(?:" + "|".join(OTHER_NAMES) + r")\b", re.I)
#: White space (that of Unicode too) and quotes before an assigned value, and what ends one.
_BLANK = rb"[\t-\r\x1c- ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
_LEAD = re.compile(rb"(?:" + _BLANK + rb")*[\"'`]?")
_END = re.compile(_BLANK + rb"|[\"'`,;<>(){}]")
_WORDS = re.compile("|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=len, reverse=True)), re.I)
_UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_KEY_BYTE = np.array([chr(x).isascii() and (chr(x).isalnum() or chr(x) in "+/_-.=") for x in range(256)])
_DIGIT = np.array([0x30 <= x <= 0x39 for x in range(256)])
_ASSIGN = np.array([chr(x) in "=:" for x in range(256)])
_WHITE, _IN_NAME = frozenset(b"\t\n\x0b\x0c\r "), frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")


def assigned_name(data: bytes, at: int) -> str | None:
    """The name to which what begins at a place is assigned: before =, :, := or =>, with quotes or a bracket after it."""
    if at and data[at - 1] in b"\"'`":
        at -= 1
    while at and data[at - 1] in _WHITE:
        at -= 1
    if data[max(0, at - 2) : at] in (b"=>", b":="):
        at -= 2
    elif data[max(0, at - 1) : at] in (b"=", b":"):
        at -= 1
    else:
        return None
    while at and data[at - 1] in _WHITE:
        at -= 1
    for _ in range(2):
        at -= bool(at and data[at - 1] in b"\"']")
    end = at
    while at and data[at - 1] in _IN_NAME:
        at -= 1
    name = data[at:end].decode().lstrip("0123456789_.-")
    return name if len(name) > 1 else None


def candidates(data: bytes) -> list[tuple[int, int]]:
    """Spans (byte offsets) of one text's candidates, in order; of two that overlap, the one that starts first."""
    codes = np.frombuffer(data, np.uint8)
    if not len(codes):
        return []
    inside = _KEY_BYTE[codes]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, ends = edge[::2], edge[1::2]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[codes])])
    keep = (ends - starts >= LEAST) & (digits[ends] > digits[starts])
    spans = []
    for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
        run = data[a:b]
        name = re.match(rb"[A-Za-z_][A-Za-z0-9_.-]*=(?=.)", run)  # name=value in one run
        a += name.end() if name else 0
        b -= len(run) - len(run.rstrip(b".-"))
        a += len(data[a:b]) - len(data[a:b].lstrip(b".-="))
        if b - a >= LEAST:
            spans.append((a, b))
    end = bare = 0  # where the last value looked at ends, with and without the punctuation at its end
    for at in np.flatnonzero(_ASSIGN[codes]).tolist():
        at += data[at : at + 2] == b"=>"
        name = assigned_name(data, at + 1)
        if name and _SECRET_NAME.search(name):
            head = _LEAD.match(data, at + 1).end()
            if head >= end:  # else it is a part of that value, and ends where it does
                stop = _END.search(data, head)
                end = stop.start() if stop else len(data)
                bare = head + len(data[head:end].rstrip(b"!#$%&*.?"))
            if bare > head and len(data[head : min(bare, head + 4 * VALUE_LEAST)].decode(errors="ignore")) >= VALUE_LEAST:
                spans.append((head, bare))
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int]] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def describe(value: str, before: str, after: str, name: str | None) -> list[float]:
    """Features of a candidate in its context, and of the name that it is assigned to."""
    n = m = len(value)
    shape = value
    signs, at, times = np.unique(np.frombuffer(value.encode("utf-32-le"), np.uint32), return_inverse=True, return_counts=True)
    kinds = np.array([_kind(chr(c)) for c in signs])
    share = (np.bincount(kinds, times, 4) / m).tolist()
    changes = int(np.count_nonzero(np.diff(kinds[at]))) / max(1, m - 1)
    lower: Counter[str] = Counter()
    for c, k in zip(signs.tolist(), times.tolist(), strict=True):
        for x in chr(c).lower():
            lower[x] += k
    entropy = -sum(k / m * math.log2(k / m) for k in lower.values())
    covered = sum(len(x) for x in _WORDS.findall(shape)) / m
    runs = [len(x) for x in re.findall(r"[A-Za-z]+", shape)]
    words = re.findall(r"[A-Za-z_]+", before)[-3:]
    near = " ".join(words)
    parts = re.split(r"[/.]", shape)
    return [
        math.log(n), *share, changes, entropy, entropy / math.log2(max(2, m)), covered, max(runs, default=0) / m,
        float(bool(_HEX.fullmatch(shape))), float(bool(_UUID.fullmatch(shape))), float(n in (32, 40, 64)),
        shape.count("/"), shape.count("."), shape.count("-") + shape.count("_"), len(parts), max(map(len, parts)) / m,
        float(bool(name)), float(bool(name and _SECRET_NAME.search(name))), float(bool(_SECRET_NAME.search(near))), float(bool(_OTHER_NAME.search(near))),
        float(before[-1:] in ("'", '"', "`") and before[-1:] == after[:1]), float("@" in after[:2] or "@" in before[-2:]), float(before.endswith(("/", "://", "\\"))),
        float(bool(re.search(r"example|sample|dummy|placeholder|your|xxxx|1234567|changeme", shape, re.I))),
    ]


class Forest:
    """Trees as flat arrays: feature (-1 in a leaf), threshold, children, share of true labels."""

    def __init__(self, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 11):
        self.trees, self.depth, self.least, self.random = trees, depth, least, np.random.Generator(np.random.PCG64(seed))
        self.nodes: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        tries = max(1, int(math.sqrt(x.shape[1])) + 1)
        for _ in range(self.trees):
            rows, nodes = self.random.integers(0, len(x), len(x)), []
            self._grow(x[rows], y[rows], self.depth, tries, nodes)
            self.nodes.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, tries: int, nodes: list) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0, float(y.mean())))
        if depth == 0 or len(y) < 2 * self.least or y.min() == y.max():
            return at
        best = (1e-9, -1, 0.0)
        whole = y.mean() * (1 - y.mean())
        for f in self.random.permutation(x.shape[1])[:tries]:
            order = np.argsort(x[:, f], kind="stable")
            v, left = x[order, f], np.cumsum(y[order])[:-1]
            n = np.arange(1, len(y))
            p, q = left / n, (left[-1] + y[order[-1]] - left) / (len(y) - n)
            gain = whole - (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
            gain[(v[1:] == v[:-1]) | (n < self.least) | (len(y) - n < self.least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), float(v[k] + v[k + 1]) / 2)
        if best[1] < 0:
            return at
        low = x[:, best[1]] <= best[2]
        first = self._grow(x[low], y[low], depth - 1, tries, nodes)
        second = self._grow(x[~low], y[~low], depth - 1, tries, nodes)
        nodes[at] = (best[1], best[2], first, second, nodes[at][4])
        return at

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, first, second, share in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                low = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(feature[at] < 0, at, np.where(low, first[at], second[at]))
            total += share[at]
        return total / max(1, len(self.nodes))


def example_findings(n: int = 9000, seed: int = 7) -> list[tuple[str, str, str, bool]]:
    """Labelled findings (value, before, after, true) made from a seed: keys of common formats and passwords that are
    assigned to names of secrets, keys of known forms and lines of key files that stand alone, and hashes, ids, paths,
    addresses, numbers and samples that are not secrets."""
    r = random.Random(seed)
    pick = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    hexes, mixed, word = "0123456789abcdef", string.ascii_letters + string.digits, lambda: r.choice(DICTIONARY)
    filler = lambda: " ".join(pick(string.ascii_lowercase, 2, 9) for _ in range(4)).capitalize()
    true = [
        lambda: pick(hexes, 40, 40), lambda: pick(hexes, 32, 32), lambda: pick(hexes, 64, 64), lambda: pick(mixed, 20, 64), lambda: pick(mixed + "+/", 38, 64) + "==",
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16, 16), lambda: "ghp_" + pick(mixed, 36, 36), lambda: "sk-" + pick(mixed, 32, 48),
        lambda: pick(mixed + "_-", 20, 30) + "." + pick(mixed + "_-", 20, 60), lambda: pick(hexes, 12, 28), lambda: pick(mixed + "!#%&*?", 8, 16), lambda: pick(mixed + "!#%&*?", 60, 1200),
    ]
    bare = [
        *[lambda: ("AKIA" + pick(string.ascii_uppercase + string.digits * k, 16, 16), " ") for k in (1, 1, 2)], lambda: ("ghp_" + pick(mixed, 36, 36), " "), lambda: ("sk-" + pick(mixed, 24, 48), " "),
        lambda: (f"xoxb-{pick(string.digits, 11, 12)}-{pick(string.digits, 11, 12)}-{pick(mixed, 24, 24)}", " "), lambda: (pick(mixed + "+/", 64, 64), " KEY-----\n"), lambda: (pick(mixed + "+/", 64, 64), pick(mixed + "+/", 50, 63) + "\n"),
        lambda: ("sk-" + pick(mixed, 24, 48), f" https://{word()}.example.com/?{word()}="), lambda: ("ghp_" + pick(mixed, 36, 36), " https://"),
    ]
    false = [
        lambda: (pick(hexes, 40, 40), f" {r.choice(['commit', 'revision', 'tree', 'sha1', 'blob'])} "), lambda: (pick(hexes, 64, 64), f" {r.choice(['sha256', 'digest', 'checksum'])}: "),
        lambda: (pick(hexes, 32, 32), f" {r.choice(['md5', 'etag'])}="), lambda: (str(uuid.UUID(int=r.getrandbits(128))), f" {r.choice(['id', 'uuid', 'guid', 'see'])} = "),
        lambda: ("/".join(word() for _ in range(r.randint(3, 6))) + f"/{r.randint(1, 2030)}", " https://"), lambda: ("-".join(word() for _ in range(r.randint(3, 5))) + f"-{r.randint(1, 99)}", " "),
        lambda: (pick(string.digits, 16, 20), " "), lambda: (pick(string.digits, 16, 16), " card "), lambda: (f"{word()}.{r.randint(1, 999)}", " ") if r.random() < 0.1 else (f"{word()}_{word()}_{word()}.{r.randint(1, 999)}.{word()}", " "),
        lambda: (f"{word()}.{word()}{r.randint(1, 99)}.example.com", f" {word()}@"), lambda: (f"{r.randint(2000, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}", " at "),
        lambda: (pick(string.ascii_lowercase, 10, 22) + str(r.randint(1, 99)), " "), lambda: (f"your_{r.choice(['token', 'key', 'password'])}_here{r.randint(1, 9)}", f" {r.choice(SECRET_NAMES)} = \""),
        lambda: ("x" * r.randint(6, 30), f" {r.choice(SECRET_NAMES)}="), lambda: (f"{r.choice(['example', 'dummy', 'changeme', 'placeholder'])}{r.randint(1, 12345)}", f" {r.choice(SECRET_NAMES)}: "),
        lambda: (f"{word()}_{word()}_{word()}", f" {r.choice(SECRET_NAMES)} = "), lambda: (f"v{r.randint(1, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}-{word()}.{r.randint(100000, 999999)}", " version "),
    ]
    out = []
    for _ in range(n // 2):
        quote, cased = r.choice(['"', "'", "", '"']), r.choice([str, str, str, str.upper])
        name = r.choice(SECRET_NAMES) if r.random() < 0.85 else f"{word()}_{r.choice(SECRET_NAMES)}"
        lead = f"{filler()} {name}{r.choice([' = ', '=', ': ', ' := '])}{quote}"
        value = r.choice(true)()
        end = quote + r.choice(["", "!!", "###", "$$$", ";", ","]) + " " + filler()
        if r.random() < 0.3:
            value, lead = r.choice(bare)()
            out.append((value, (filler() + lead)[-CONTEXT:], (r.choice(["", ".", ",", "\n", "@"]) + " " + filler())[:CONTEXT], True))
        else:
            out.append((cased(value), cased(lead)[-CONTEXT:], cased(end)[:CONTEXT], True))
        value, lead = r.choice(false)()
        out.append((cased(value), cased(filler() + lead)[-CONTEXT:], cased(r.choice(["", ".", ",", "%%%"]) + " " + filler())[:CONTEXT], False))
    return out


def _described(value: str, before: str, after: str) -> list[float]:
    """Features of a labelled finding, whose name is in its context."""
    own = before.encode()
    return describe(value, before[-CONTEXT:], after[:CONTEXT], assigned_name(own, len(own)))


def train(findings: DataFrame | None = None, rows: int = ROWS, **forest) -> Forest:
    """A forest from labelled findings (value, before, after, label true for a secret; nulls ignored).

    Of at most ``rows`` of them, those with the least hash, the features go to the driver, never the texts.
    """
    if findings is None:
        got = [(*_described(v, b, a), float(y)) for v, b, a, y in example_findings()]
    else:
        whole = findings.filter("value is not null and value <> '' and label is not null").select(
            "value", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), F.col("label").cast("boolean").alias("label")
        )
        chosen = whole.orderBy(F.xxhash64("value", "before", "after"), "value", "before", "after").limit(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [[*_described(*x[:3]), float(x[3])] for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64()))], ["x"])

        got = [r[0] for r in chosen.mapInArrow(run, "x array<double>").collect()]
        if not got:
            raise ValueError("no labelled finding to train from")
    x = np.array(got)
    return Forest(**forest).fit(x[:, :-1], x[:, -1])


def scan_secrets(docs: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """A row for each finding: doc_id, start (characters before it), n_chars, value_sha256, name (that it is assigned to, or
    null), score. Findings under ``least`` are left out.

    docs has doc_id and text; other columns are ignored. Null and empty texts have no findings; repeated rows have
    theirs each. A row with a null doc_id keeps it null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            rows, x = [], []
            for first, data, offsets in slices(part.column("text")):
                for i in range(len(offsets) - 1):
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    spans = candidates(text)
                    if not spans:
                        continue
                    # a character begins at each byte that goes on with none
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                    for a, b in spans:
                        value, before, after = (text[p:q].decode(errors="replace") for p, q in ((a, b), (max(0, a - CONTEXT), a), (b, b + CONTEXT)))
                        name = assigned_name(text, a)
                        rows.append((first + i, int(chars[a]), value, name))
                        x.append(describe(value, before, after, name))
            if rows:
                score = forest(np.array(x))
                keep = np.flatnonzero(score >= least)
                chosen = [rows[k] for k in keep]
                ids = part.column("doc_id").take(pa.array([c[0] for c in chosen], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([c[1] for c in chosen], pa.int64()), pa.array([c[2] for c in chosen], pa.string()), pa.array([c[3] for c in chosen], pa.string()), pa.array(score[keep])],
                    ["doc_id", "start", "value", "name", "score"],
                )

    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, start long, value string, name string, score double")
    return found.select("doc_id", "start", F.length("value").cast("long").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "name", "score")
