"""Text that was decoded with the wrong character encoding: find it, and restore it where possible.

Interpolated character n-gram models (orders 1 to 3 over a bounded alphabet, backed by character classes) are trained
on the counts of all clean records. Every run of non-ASCII characters is rewritten by every candidate chain of
encode-decode steps, each rewriting is scored in its context, and the likeliest is accepted if it beats the text as it
stands by a margin. The margin is validated on all distinct contexts of the clean records: as they are, and garbled on purpose.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospark.session import checkpointed

#: Codecs by which UTF-8 is misread, and pairs (read as, was) of single-byte codecs mistaken for one another.
MISREAD_UTF8 = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850")
MISREAD_BYTES = (
    ("cp1251", "cp1252"),
    ("latin-1", "cp1252"),
    ("cp1253", "cp1252"),
    ("koi8-r", "cp1252"),
    ("mac_roman", "cp1252"),
    ("cp437", "cp1252"),
    ("cp850", "cp1252"),
    ("cp1250", "cp1252"),
    ("cp1252", "mac_roman"),
    ("cp1252", "cp850"),
)
#: A chain has at most this many UTF-8 steps (text garbled twice or three times).
MAX_STEPS = 3
CONTEXT = 2
#: Gains are counted by steps of this part of a nat, and no margin is higher than ``MOST``.
STEPS, MOST = 100, 20.0
#: A model has at most so many triples: about 20 bytes each on the way to the workers.
MOST_TRIPLES = 3_000_000
#: A worker holds distinct contexts up to so many characters before it passes them on.
HELD_CHARACTERS = 4_000_000
#: Longer runs (whole passages in another script) are judged anew each time instead of being remembered.
MEMO_LENGTH = 64

_RUN = re.compile(r"[^\x00-\x7f]+")
_MIXED = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ÖØ-öø-ɏ0-9]")
_C1 = re.compile("[\x80-\x9f]")
_LOST = "�"

# --- byte tables -------------------------------------------------------------------------------------------------


def byte_table(codec: str) -> dict[str, int]:
    """Character -> byte for the upper half of a codec; a byte that it leaves undefined stands for the C1 control."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


_BYTES = {c: byte_table(c) for c in {*MISREAD_UTF8, *(c for pair in MISREAD_BYTES for c in pair)}}
_CHARS = {c: {b: ch for ch, b in t.items()} for c, t in _BYTES.items()}


def _sequence(codec: str) -> re.Pattern:
    def some(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in _BYTES[codec].items() if lo <= b <= hi) + "]"

    more = some(0x80, 0xBF)
    return re.compile(f"{some(0xC2, 0xDF)}{more}|{some(0xE0, 0xEF)}{more}{{2}}|{some(0xF0, 0xF4)}{more}{{3}}")


_SEQUENCE = {c: _sequence(c) for c in MISREAD_UTF8}


def _step(codec: str, run: str) -> str:
    """``run`` with every character sequence that is UTF-8 read as ``codec`` put right."""
    table = _BYTES[codec]

    def right(m: re.Match) -> str:
        try:
            return bytes(table[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return _SEQUENCE[codec].sub(right, run)


def candidates(run: str) -> dict[str, str]:
    """Rewritings of a run -> the chain that makes them, shortest chains first."""
    found: dict[str, str] = {}
    level = {run: ""}
    for _ in range(MAX_STEPS):
        following: dict[str, str] = {}
        for text, chain in level.items():
            for codec in MISREAD_UTF8:
                out = _step(codec, text)
                if out != text and out != run and out not in found:
                    following.setdefault(out, f"{chain}utf-8 as {codec};")
        found |= following
        level = following
        if not level:
            break
    for read, was in MISREAD_BYTES:
        out = "".join(_CHARS[was].get(_BYTES[read].get(c, -1), c) for c in run)
        if out != run and not _C1.search(out):
            found.setdefault(out, f"{was} as {read};")
    return found


def garble(text: str, codec: str, was: str = "utf-8") -> str:
    """``text`` written in ``was`` and read as ``codec``; characters that ``was`` lacks stay as they are."""
    chars = _CHARS[codec]

    def wrong(c: str) -> str:
        if was == "utf-8":
            return "".join(chars[b] for b in c.encode("utf-8"))
        return chars[_BYTES[was][c]] if c in _BYTES[was] else c

    return "".join(c if c < "\x80" else wrong(c) for c in text)


# What ordinary Western text, drawn lines and redaction marks turn into, to keep garbled records out of the training
# and the validation: fixed by rule, not by data.
_COMMON = [*map(chr, range(0xA0, 0x100)), *"ŒœŠšŽžŸƒ–—‘’‚“”„†‡•…‰‹›€™", *map(chr, range(0x2500, 0x2600))]
_TRACES = frozenset(garble(c, codec) for c in _COMMON for codec in MISREAD_UTF8)


def looks_garbled(run: str) -> bool:
    """Whether a run holds a trace of misread UTF-8, a replacement character or a C1 control."""
    if _LOST in run or _C1.search(run):
        return True
    return any(run[i : i + n] in _TRACES for n in (2, 3) for i in range(len(run) - n + 1))


# --- alphabet ----------------------------------------------------------------------------------------------------

_DIRECT = 0x600
_SYMBOLS = 0x2000
_SYMBOLS_END = 0x2600
_OTHER = _DIRECT + _SYMBOLS_END - _SYMBOLS
#: Symbols of the alphabet: code points below 0x600 and the symbol blocks one by one, all others by kind.
ALPHABET = _OTHER + 8


def _symbols(points: np.ndarray) -> np.ndarray:
    out = np.full(len(points), _OTHER, np.int32)
    low, mid = points < _DIRECT, (points >= _SYMBOLS) & (points < _SYMBOLS_END)
    out[low] = points[low]
    out[mid] = points[mid] - _SYMBOLS + _DIRECT
    out[(points >= 0x3000) & (points < 0xA000)] = _OTHER + 1
    out[(points >= 0xAC00) & (points < 0xD800)] = _OTHER + 2
    out[(points >= 0x600) & (points < 0x1E00)] = _OTHER + 3
    out[(points >= 0x1E00) & (points < 0x2000)] = _OTHER + 4
    out[(points >= 0xFB00) & (points < 0xFB50)] = _OTHER + 5
    out[points == 0xFFFD] = _OTHER + 6
    out[points >= 0x10000] = _OTHER + 7
    return out


def symbols(text: str) -> np.ndarray:
    return _symbols(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32))


def _classes() -> np.ndarray:
    """Kind of each symbol: letters by script and case, digits, blanks, punctuation, symbols by block."""
    out = np.zeros(ALPHABET, np.int64)
    for i in range(_OTHER):
        point = i if i < _DIRECT else i - _DIRECT + _SYMBOLS
        c = chr(point)
        if point < 0x80:
            kind = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 4 if point >= 32 else 5
        elif point < 0x250:
            kind = 6 if point < 0xA0 else 7 if not c.isalpha() else 8 if c.islower() else 9
            kind = 10 if point >= 0x100 and c.isalpha() else kind
        elif point < _DIRECT:
            kind = 11 if point < 0x300 else 12 if point < 0x370 else 13 if point < 0x400 else 14 if point < 0x530 else 15
        else:
            kind = 16 if point < 0x2070 else 17 if point < 0x2150 else 18 if point < 0x2500 else 19
        out[i] = kind
    out[_OTHER:] = 20 + np.arange(8)
    return out


_CLASS = _classes()
_KINDS = int(_CLASS.max()) + 1
_SIZE = np.bincount(_CLASS, minlength=_KINDS)

# --- model -------------------------------------------------------------------------------------------------------


def is_clean(text: str | None, memo: dict[str, bool]) -> bool:
    if not text:
        return False
    if text.isascii():
        return True
    if _MIXED.search(text):
        return False
    for run in set(_RUN.findall(text)):
        bad = memo.get(run)
        if bad is None:
            bad = looks_garbled(run)
            if len(run) <= MEMO_LENGTH:
                memo[run] = bad
        if bad:
            return False
    return True


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, code, context, count): n-grams of the clean records of a partition; those of ASCII alone only as single and pair.

    The distinct contexts of their runs come as rows of n = 0.
    """
    memo: dict[str, bool] = {}
    contexts: set[str] = set()
    held = 0
    single, ascii_pairs = np.zeros(ALPHABET, np.int64), np.zeros(128 * 128, np.int64)
    rest: dict[int, Counter] = {2: Counter(), 3: Counter()}
    for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
        clean = [t for t in batch.column("text").to_pylist() if is_clean(t, memo)]
        if len(memo) > 500_000:
            memo.clear()
        if not clean:
            continue
        new = {"".join(_context(t, *m.span())) for t in clean if not t.isascii() for m in _RUN.finditer(t)} - contexts
        contexts |= new
        held += sum(map(len, new))
        if held > HELD_CHARACTERS:
            yield _context_rows(contexts)
            contexts, held = set(), 0
        s = symbols("\n\n" + "\n\n".join(clean))
        single += np.bincount(s, minlength=ALPHABET)
        high = s >= 128
        pair = s[:-1] * ALPHABET + s[1:]
        mixed = high[:-1] | high[1:]
        plain = ~mixed
        ascii_pairs += np.bincount(s[:-1][plain] * 128 + s[1:][plain], minlength=128 * 128)
        three = high[:-2] | high[1:-1] | high[2:]
        for n, codes in ((2, pair[mixed]), (3, pair[:-1][three].astype(np.int64) * ALPHABET + s[2:][three])):
            rest[n].update(dict(zip(*(x.tolist() for x in np.unique(codes, return_counts=True)), strict=True)))
    yield _context_rows(contexts)
    used = np.flatnonzero(single)
    pairs = np.flatnonzero(ascii_pairs)
    out = [(1, used, single[used]), (2, pairs // 128 * ALPHABET + pairs % 128, ascii_pairs[pairs])]
    out += [(n, np.fromiter(c.keys(), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))) for n, c in rest.items()]
    for n, codes, counts in out:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(codes), n, np.int32)), pa.array(codes.astype(np.int64)), pa.nulls(len(codes), pa.string()), pa.array(counts.astype(np.int64))],
            ["n", "code", "context", "count"],
        )


def _context_rows(contexts: set[str]) -> pa.RecordBatch:
    zeros = np.zeros(len(contexts), np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(zeros.astype(np.int32)), pa.array(zeros), pa.array(sorted(contexts), pa.string()), pa.array(zeros)], ["n", "code", "context", "count"]
    )


@dataclass
class Model:
    """Interpolated n-gram probabilities; ``strength`` is the weight of the shorter history."""

    single: dict[int, int]
    pairs: dict[int, int]
    triples: dict[int, int]
    strength: float = 3.0
    #: Gains that a rewriting must reach: one by UTF-8 steps, one by single-byte codecs.
    margins: tuple[float, float] = (6.0, 14.0)
    _memo: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        pair_kinds = np.ones((_KINDS, _KINDS))
        for code, n in self.pairs.items():
            a, b = divmod(code, ALPHABET)
            pair_kinds[_CLASS[a], _CLASS[b]] += n
        # a script keeps to itself, even one that the corpus hardly has
        pair_kinds[np.arange(_KINDS), np.arange(_KINDS)] += 10
        self._kinds = pair_kinds / pair_kinds.sum(1, keepdims=True)
        self._kind_total = np.zeros(_KINDS)
        for code, n in self.single.items():
            self._kind_total[_CLASS[code]] += n

    def _p(self, a: int, b: int, c: int) -> float:
        k = _CLASS[c]
        p = self._kinds[_CLASS[b], k] * (self.single.get(c, 0) + 0.5) / (self._kind_total[k] + 0.5 * _SIZE[k])
        p = (self.pairs.get(b * ALPHABET + c, 0) + self.strength * p) / (self.single.get(b, 0) + self.strength)
        ab = a * ALPHABET + b
        return (self.triples.get(ab * ALPHABET + c, 0) + self.strength * p) / (self.pairs.get(ab, 0) + self.strength)

    def score(self, text: str) -> float:
        """Log-likelihood of a text after its first two characters, without the trigrams of ASCII alone."""
        s = symbols(text).tolist()
        total = 0.0
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            if a < 128 and b < 128 and c < 128:
                continue
            if (v := self._memo.get((a, b, c))) is None:
                v = self._memo[a, b, c] = math.log(self._p(a, b, c))
            total += v
        return total

    def best(self, left: str, run: str, right: str) -> list[tuple[float, str, str]]:
        """(gain, rewriting, chain) of the likeliest rewriting of a run by UTF-8 steps, and by single-byte codecs.

        A gain of -inf stands for none.
        """
        out = [(-math.inf, run, ""), (-math.inf, run, "")]
        found = candidates(run)
        if found:
            stands = self.score(left + run + right)
            for text, chain in found.items():
                gain = self.score(left + text + right) - stands
                kind = not chain.startswith("utf-8")
                if gain > out[kind][0]:
                    out[kind] = (gain, text, chain)
        return out


def _context(text: str, a: int, b: int) -> tuple[str, str, str]:
    left, right = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    return "\n" * (CONTEXT - len(left)) + left, text[a:b], right + "\n" * (CONTEXT - len(right))


def least_count(rows: DataFrame, most: int = MOST_TRIPLES) -> int:
    """The count that a triple needs for at most ``most`` of them to be kept, 2 at least."""
    sizes = F.floor(F.log2("count")).cast("int")
    levels = rows.where("n = 3 and count > 1").groupBy(sizes.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    least = 1
    while sum(r.n for r in levels if r.level >= least) > most:
        least += 1
    return 2**least


def train(documents: DataFrame) -> Model:
    """The model of all clean records of ``documents``, with a margin validated on all their distinct contexts.

    What is brought to the driver are n-gram counts over an alphabet of fixed size, pairs and triples only as far as
    clean text has them, and counts of gains by steps of fixed size. Triples seen once are left to the smoothing, and
    more of the rarest where more than ``MOST_TRIPLES`` would be left, which is counted first.
    """
    spark = documents.sparkSession
    rows = checkpointed(
        documents.select("text")
        .mapInArrow(_count, "n int, code bigint, context string, count bigint")
        .groupBy("n", "code", "context")
        .agg(F.sum("count").alias("count"))
    )
    counts = rows.where(F.col("n").isin(1, 2) | ((F.col("n") == 3) & (F.col("count") >= least_count(rows)))).select("n", "code", "count").toArrow()
    n, code, count = (counts.column(c).to_numpy() for c in ("n", "code", "count"))
    tables = [dict(zip(code[n == k].tolist(), count[n == k].tolist(), strict=True)) for k in (1, 2, 3)]
    model = Model(*tables)
    shared = spark.sparkContext.broadcast(model)

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, steps = context_gains(shared.value, (c for b in batches for c in b.column("context").to_pylist()))
        found = [(k, step, n, ordinary[k]) for k in (0, 1) for step, n in [(-1, 0), *steps[k].items()]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "step", "count", "ordinary"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = (
        rows.where("n = 0")
        .select("context")
        .repartition(parts, "context")
        .mapInArrow(gains, "kind int, step int, count bigint, ordinary double")
        .groupBy("kind", "step")
        .agg(F.sum("count").alias("count"), F.max("ordinary").alias("ordinary"))
        .collect()
    )
    model.margins = validated_margins(
        [max((r.ordinary for r in seen if r.kind == k), default=0.0) for k in (0, 1)],
        [{r.step: r["count"] for r in seen if r.kind == k and r.step >= 0} for k in (0, 1)],
    )
    return model


def context_gains(model: Model, contexts: Iterable[str]) -> tuple[list[float], list[Counter]]:
    """Of clean contexts, for UTF-8 steps and for single-byte codecs: the highest gain of rewriting one as it is (0 at
    least), and how many gains of restoring one garbled on purpose, by every chain, fall into each step.

    A step is a hundredth of a nat; below 0 and above 4 times ``MOST`` a gain makes no difference to the margin.
    """
    ordinary, steps = [0.0, 0.0], [Counter(), Counter()]
    chains = [(c, "utf-8", 0) for c in MISREAD_UTF8] + [(read, was, 1) for read, was in MISREAD_BYTES]
    for context in contexts:
        left, run, right = context[:CONTEXT], context[CONTEXT:-CONTEXT], context[-CONTEXT:]
        for kind, (gain, _, _) in enumerate(model.best(left, run, right)):
            ordinary[kind] = max(ordinary[kind], gain)
        stands = model.score(context)
        for codec, was, kind in chains:
            if (wrong := garble(run, codec, was)) != run:
                gain = stands - model.score(left + wrong + right)
                steps[kind][int(min(max(gain, 0.0), 4 * MOST) * STEPS)] += 1
    return ordinary, steps


def validated_margins(ordinary: list[float], steps: list[dict[int, int]], least: tuple[float, float] = (4.0, 14.0), most: float = MOST) -> tuple[float, float]:
    """Margins above the gains of rewriting clean text and, as far as may be, below those of restoring garbled text.

    For UTF-8 steps and for single-byte codecs: a quarter of the way from the highest of the former to the hundredth
    part of the latter, at least 1 above the former, and within [least, most]. Single-byte codecs turn letters into letters, so
    their margin starts higher; a garbled document has many runs, of which one must pass.
    """
    low = [most, most]
    for k, counts in enumerate(steps):
        rank = sum(counts.values()) // 100
        for step in sorted(counts):
            low[k], rank = step / STEPS, rank - counts[step]
            if rank < 0:
                break
    return tuple(min(most, max(least[k], ordinary[k] + 1, (3 * ordinary[k] + low[k]) / 4)) for k in (0, 1))


class Restorer:
    """Finds and restores garbled runs with a model; the best rewritings are remembered by run and context."""

    def __init__(self, model: Model):
        self.model = model
        #: Run with its context -> its best rewritings, or None if none makes it likelier and nothing was lost.
        self.memo: dict[str, list[tuple[float, str, str]] | None] = {}

    def _best(self, key: str, size: int) -> list[tuple[float, str, str]] | None:
        left, run, right = key[:CONTEXT], key[CONTEXT : CONTEXT + size], key[CONTEXT + size :]
        best = self.model.best(left, run, right)
        if _LOST in run:  # what was lost can't have been one byte each
            best[1] = (-math.inf, run, "")
        elif max(gain for gain, _, _ in best) <= 0 and not _C1.search(run):
            best = None
        if len(key) <= MEMO_LENGTH:
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[key] = best
        return best

    def restore(self, text: str) -> tuple[int, int, str, str]:
        """(garbled runs, runs not wholly restored, restored text, chains used).

        A chain that one run of the text proves is taken for its other runs where it makes them likelier at all.
        """
        pad = "\n" * CONTEXT
        padded = pad + text + pad
        memo, unknown, runs = self.memo, object(), []
        for m in _RUN.finditer(padded):
            a, b = m.span()
            key = padded[a - CONTEXT : b + CONTEXT]
            best = memo.get(key, unknown)
            if best is unknown:
                best = self._best(key, b - a)
            if best is not None:
                runs.append((a - CONTEXT, b - CONTEXT, best))
        proven: dict[str, None] = {}
        for _, _, best in runs:
            kind = int(best[1][0] > best[0][0])
            if best[kind][0] >= self.model.margins[kind]:
                proven[best[kind][2]] = None
        parts, at, garbled, lost = [], 0, 0, 0
        for a, b, best in runs:
            gain, right, chain = max(((g, t, c) for g, t, c in best if c in proven), default=(0.0, "", ""))
            if gain > 0:
                garbled += 1
                lost += _LOST in right
                parts += [text[at:a], right]
                at = b
            elif _LOST in text[a:b] or _C1.search(text[a:b]):
                garbled += 1
                lost += 1
        return garbled, lost, "".join([*parts, text[at:]]), "".join(proven)


def garbled_documents(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_garbled, n_lost, restored_text, chains) of every row whose text holds a garbled sequence.

    ``n_lost`` counts the sequences that can't be restored (those with replacement characters), which restored_text
    keeps as they are. Null, empty, blank and ASCII texts are never garbled. Repeated rows give repeated results,
    other columns are ignored, texts are read whole. An empty table trains an empty model and gives no rows.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model or train(documents))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            found = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text and not text.isascii():
                    garbled, *rest = restorer.restore(text)
                    if garbled:
                        found.append((i, garbled, *rest))
            at, n, lost, texts, chains = zip(*found, strict=True) if found else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(n, pa.int32()), pa.array(lost, pa.int32()),
                 pa.array(texts, pa.string()), pa.array(chains, pa.string())],
                ["doc_id", "n_garbled", "n_lost", "restored_text", "chains"],
            )

    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_garbled int, n_lost int, restored_text string, chains string"
    )
