"""Corpus documents that hold passages of held-out test items.

Method: CGK embedding with bit-sampling LSH, then exact edit verification.
Texts are reduced to their letters and digits.  From every word of a document
and of an item a window of ``WINDOW`` characters is walked by random walks
that advance on a random bit of (step, symbol), shared by both sides: close
windows (in edit distance) come out with close walks (in Hamming distance).
Each of ``WALKS * SAMPLES`` hashes reads a few random steps of a walk; a window
of a document and one of an item that agree in any hash are a candidate pair.

The corpus is read once, whatever the number of items.  The items' hashes form
a partitioned index table; only its marks, a bitmap of bounded size, go to the
executors, and the scan keeps the hashes they admit, with the letters around
them.  Those are joined to the index by hash, and every stretch of ``SHORTEST``
to ``LONGEST`` words of the item around a meeting is verified by weighted edit
distance, or excluded by a bound that is proven not to exceed it.  An index of
at most ``SMALL_INDEX`` hashes is sent to the scan instead, which then joins
and verifies on the spot: another plan, the same rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.text_forms import folded, plain_words
from rallyframe.util import materialize, salted_join, shuffle_partitions, widened

WINDOW = 32
STEPS = 2 * WINDOW
WALKS = 3
SAMPLES = 3
SAMPLED_STEPS = 10
SHORTEST, LONGEST = 16, 24
COMMON = 3
# edit costs are whole numbers: a word of the item weighs UNIT, an extra letter of the document INSERTION
UNIT = 500
INSERTION = 40
DRIFT = 24
SPREAD = 8
BAND = DRIFT + SPREAD
REGION = 4096
# one word in CHANGED_OF may be changed, and SLIPS of a word in letters
CHANGED_OF, SLIPS, CHANGED, LONGER = 8, 0.3, 1 / 3, 0.4
MARK_BITS = 30
SMALL_INDEX = 1 << 21
_BIG = np.uint16(20_000)
_SENTENCE = re.compile(r"(?<=[.?!])[\"”’']?\s+")


def allowed_words(words: int) -> float:
    """How many words of a stretch may be changed, letter slips counted by their share of a word."""
    return words / CHANGED_OF + SLIPS


def changed_words(costs: np.ndarray) -> np.ndarray:
    """Running count of changed words from the running costs of an alignment (in words).

    A word that adds less than ``CHANGED`` is a slip and counts as much; else it
    counts as one, or what it adds if that is more.  After a changed word up to
    ``LONGER`` is forgiven: the letters by which the new word is longer.
    """
    step = np.diff(costs, axis=0, prepend=0.0)
    changed = np.zeros(costs.shape[1], bool)
    for row in step:
        row -= np.where(changed, np.minimum(row, LONGER), 0.0)
        changed = row >= CHANGED
        row[changed] = np.maximum(row[changed], 1.0)
    return np.cumsum(step, axis=0)


# ---- items -------------------------------------------------------------------


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [_SENTENCE.split(t.strip()) if t and t.strip() else [] for t in batch.column(1).to_pylist()]
        opening = [folded(p[0]) if len(p) > 1 else None for p in parts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(parts, pa.list_(pa.string())), pa.array(opening, pa.string())], names=["item_id", "sentences", "opening"]
        )


def passage(sentences: list[str], opened: bool) -> list[str]:
    """Words of an item without a common opening line and without a closing question."""
    if len(sentences) > 1 and opened:
        sentences = sentences[1:]
    if len(sentences) > 1 and sentences[-1].rstrip("\"”’'").endswith("?"):
        sentences = sentences[:-1]
    return plain_words(" ".join(sentences))


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [passage(s, bool(o)) for s, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["item_id", "words"])


def item_passages(items: DataFrame) -> DataFrame:
    """item_id, words of each item's passage, without opening line and closing question.

    A sentence that opens ``COMMON`` or more items is an opening line, counted
    over the whole table; a last sentence ending in a question mark is the
    question.  Of several texts under one id the least holds.  What is left
    empty by that is no passage.
    """
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")
    asked = asked.groupBy("item_id").agg(F.min("text").alias("text"))
    split = materialize(asked.mapInArrow(_sentences, "item_id bigint, sentences array<string>, opening string"))
    common = split.where("opening is not null").groupBy("opening").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    # an opening line may open a third of all items
    opened = salted_join(split, common.select("opening", F.lit(True).alias("opened")), ["opening"], [F.col("item_id")], "left", 4)
    words = opened.select("item_id", "sentences", F.coalesce("opened", F.lit(False)).alias("opened"))
    return words.mapInArrow(_passages, "item_id bigint, words array<string>").where("size(words) > 0")


# ---- walks and hashes --------------------------------------------------------


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii"), np.uint8)


class WalkHashes:
    """The shared random walks and the steps each hash reads."""

    def __init__(self, seed: int = 20_260):
        rng = np.random.default_rng(seed)
        self.bits = rng.integers(0, 2, (WALKS, STEPS, 128), dtype=np.int64)
        reads = [[set(rng.choice(STEPS, SAMPLED_STEPS, replace=False).tolist()) for _ in range(SAMPLES)] for _ in range(WALKS)]
        factors = rng.integers(1, 1 << 62, (WALKS, SAMPLES, STEPS), dtype=np.uint64) | np.uint64(1)
        self.users = [[[(s, factors[w, s, j]) for s in range(SAMPLES) if j in reads[w][s]] for j in range(STEPS)] for w in range(WALKS)]
        self.last = [max(j for j in range(STEPS) if self.users[w][j]) for w in range(WALKS)]
        self.salt = rng.integers(1, 1 << 62, (WALKS * SAMPLES, 1), dtype=np.uint64)

    def __call__(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(hashes, windows) of the windows that begin at ``starts`` of ``text`` (padded by WINDOW)."""
        out = np.empty((WALKS * SAMPLES, len(starts)), np.uint64)
        for k in range(0, len(starts), 8192):  # as much as a core's cache holds
            out[:, k : k + 8192] = self._block(text, starts[k : k + 8192])
        return out

    def _block(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.repeat(self.salt, len(starts), axis=1)
        term = np.empty(len(starts), np.uint64)
        for w in range(WALKS):
            at = starts.astype(np.int64)
            for j in range(self.last[w] + 1):
                symbol = text.take(at)
                if self.users[w][j]:
                    wide = symbol.astype(np.uint64)
                    for s, factor in self.users[w][j]:
                        np.multiply(wide, factor, out=term)
                        out[w * SAMPLES + s] += term
                at += self.bits[w, j].take(symbol)
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        return out


def _starts(words: list[str]) -> np.ndarray:
    return np.cumsum([0, *map(len, words)])[:-1]


def item_windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters padded for walks, first word of each window) of an item: every word with a whole window ahead.

    Windows that repeat within the item, with all of their ``LONGEST`` words to
    either side, can only find the same, so one of each stays.
    """
    text, starts = "".join(words), _starts(words)
    full = np.flatnonzero(starts <= len(text) - WINDOW)
    if len(set(words)) < len(words):
        seen: dict[tuple, int] = {}
        for w in full.tolist():
            seen.setdefault((min(w, LONGEST), tuple(words[max(0, w - LONGEST) : w + LONGEST + WINDOW])), w)
        full = np.array(sorted(seen.values()), dtype=np.int64)
    return _codes(text + "\0" * STEPS), full


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = WalkHashes()
    for batch in batches:
        for item, words in zip(batch.column(0), batch.column(1).to_pylist()):
            text, first = item_windows(words)
            if not len(first):
                continue
            hashes = walk(text, _starts(words)[first]).view(np.int64)
            size = hashes.size
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.ravel()), pa.array([item.as_py()] * size, pa.int64()), pa.array(np.tile(first, len(hashes)).astype(np.int32))],
                names=["hash", "item_id", "word"],
            )


class Marks:
    """A bitmap that admits every hash of the index and few others; two bits a hash, both in one 64-bit word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.shift = np.uint64(64 - int(math.log2(len(words))))

    @staticmethod
    def mask(h: np.ndarray) -> np.ndarray:
        one, low = np.uint64(1), np.uint64(63)
        return (one << (h & low)) | (one << ((h >> np.uint64(6)) & low))

    def admit(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.uint64)
        m = self.mask(h)
        return (self.words.take((h >> self.shift).astype(np.int64)) & m) == m

    @staticmethod
    def of(index: DataFrame, total: int) -> Marks:
        """Marks of the ``hash`` column: 32 bits a hash, at most 2 ** MARK_BITS bits (128 MB) in all.

        Beyond that bound more hashes of the corpus pass on to the join, which
        drops them: the result stays the same.
        """
        bits = min(MARK_BITS, max(16, math.ceil(math.log2(32 * max(1, total)))))
        shift = 64 - (bits - 6)
        word = F.shiftrightunsigned("hash", shift)
        low = lambda n: F.expr(f"shiftleft(1L, cast((hash >> {n}) & 63 as int))")
        rows = index.select(word.alias("word"), low(0).bitwiseOR(low(6)).alias("mask"))
        out = np.zeros(1 << (bits - 6), np.uint64)
        rows = rows.groupBy("word").agg(F.bit_or("mask").alias("mask"))
        # at most one row for each word of the bitmap, fetched partition by partition
        for part in rows.toArrow().to_batches():
            out[part.column(0).to_numpy()] = part.column(1).to_numpy().view(np.uint64)
        return Marks(out)


# ---- corpus scan -------------------------------------------------------------

_HELD = "doc_id bigint, item_id bigint, edit_share double"
_REGIONS = "region bigint, doc_id bigint, text string, at array<int>, hash array<bigint>"


def _scan(marks, reach: int, small=None):
    """Regions of documents around admitted hashes: letters, and (place in them, hash) of each.

    With ``small``, a broadcast :class:`SmallIndex`, the pairs that hold instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, known = WalkHashes(), Marks(marks.value)
        region = TaskContext.get().partitionId() << 40
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                pieces, starts, docs, begins, base = [], [], [], [], 0
                for d, text in enumerate(batch.column(1).to_pylist()):
                    words = plain_words(text) if text else []
                    if not words:
                        continue
                    letters = "".join(words)
                    own = _starts(words)
                    own = own[: np.searchsorted(own, len(letters) - WINDOW, side="right")]
                    if not len(own):
                        continue
                    pieces.append(letters + "\0" * STEPS)
                    starts.append(own + base)
                    docs.append((d, base, len(letters)))
                    base += len(letters) + STEPS
                if not pieces:
                    continue
                flat = "".join(pieces)
                places = np.concatenate(starts)
                hashes = walk(_codes(flat), places)
                which, window = np.nonzero(known.admit(hashes))
                if not len(which):
                    continue
                order = np.argsort(window, kind="stable")
                place, value = places[window[order]], hashes[which[order], window[order]].view(np.int64)
                bases = np.array([b for _, b, _ in docs])
                owner = np.searchsorted(bases, place, side="right") - 1
                # a region ends with its document, with a gap that nothing reaches over, or when it is full
                cut = (np.diff(owner) != 0) | (np.diff(place) > 2 * reach)
                block = np.zeros(len(place), np.int64)
                block[1:] = np.cumsum(cut)
                first = np.concatenate([[0], np.flatnonzero(cut) + 1])
                part = (place - place[first][block]) // REGION
                edges = np.flatnonzero(np.concatenate([[True], (np.diff(block) != 0) | (np.diff(part) != 0)]))
                out: list[list] = [[], [], [], [], []]
                for lo, hi in zip(edges, [*edges[1:], len(place)]):
                    d, b, size = docs[owner[lo]]
                    left = max(b, int(place[lo]) - reach)
                    right = min(b + size, int(place[hi - 1]) + reach)
                    for column, x in zip(out, (region, d, flat[left:right], (place[lo:hi] - left).astype(np.int32), value[lo:hi])):
                        column.append(x)
                    region += 1
                if small is not None:
                    rows, held, share = small.value.held(out[2], out[3], out[4])
                    taken = batch.column(0).take(pa.array(np.array(out[1], np.int64)[rows]))
                    yield pa.RecordBatch.from_arrays([taken, pa.array(held), pa.array(share)], names=["doc_id", "item_id", "edit_share"])
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out[0], pa.int64()), batch.column(0).take(pa.array(out[1])), pa.array(out[2], pa.string()),
                        pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.list_(pa.int64())),
                    ],
                    names=["region", "doc_id", "text", "at", "hash"],
                )

    return run


# ---- verification ------------------------------------------------------------


def edit_costs(letters: np.ndarray, costs: np.ndarray, text: np.ndarray, band: int = BAND, insertion: int = INSERTION) -> np.ndarray:
    """Least cost of aligning each first i letters of a pattern, column by column.

    ``letters``, ``costs``: (letters, patterns); a wrong or missing letter costs
    its cost, an extra letter of the text ``insertion``.  ``text``: (letters +
    2 * band, patterns), where row ``band`` is where the pattern is expected; its
    alignment may begin anywhere up to ``band`` (even) letters off and stays so near.
    Cells are filled along diagonals i + j, so nothing depends on its neighbour.
    """
    m, n = letters.shape
    front = band + 2
    # differing letters give at least 512 by exclusive or, which bounds every cost from above
    p = np.zeros((m + 2 * front, n), np.uint16)
    p[front : front + m] = letters.astype(np.uint16) << 9
    c = np.zeros((m + 2 * front, n), np.uint16)
    c[front : front + m] = costs
    t = np.zeros((m + 2 * band + 2 * front, n), np.uint16)
    t[front : front + m + 2 * band] = text.astype(np.uint16) << 9
    best = np.full((m + 1 + 2 * front, n), _BIG, np.uint16)
    # diagonal d = 2 * i + o; offsets o of even d: -band, -band + 2, ... band; of odd d: -band + 1, ... band - 1
    one = np.zeros((band + 2, n), np.uint16)  # with an edge row to either side
    one[0] = one[-1] = _BIG
    two, cell = np.zeros((band + 1, n), np.uint16), np.empty((band + 1, n), np.uint16)
    side = np.empty((band + 1, n), np.uint16)
    ins = np.uint16(insertion)
    for d in range(-band, 2 * m + band + 1):
        even = d % 2 == 0
        count = band + 1 if even else band
        low = -band if even else -band + 1
        top = (d - low) // 2  # i of the first cell; the next ones have one letter less each
        i = slice(front + top - 1, front + top - 1 - count, -1)
        j = front + band + top + low - 1
        cost, x, new = c[i], side[:count], cell[:count]
        np.bitwise_xor(p[i], t[j : j + count], out=new)
        np.minimum(new, cost, out=new)
        new += two if even else one[1:-1]
        np.add(one[1:] if even else two[1:], cost, out=x)  # a letter of the pattern is missing
        np.minimum(new, x, out=new)
        np.add(one[:-1] if even else two[:-1], ins, out=x)  # the text has a letter more
        np.minimum(new, x, out=new)
        if top < count:
            new[max(0, top) :] = 0  # no letter of the pattern used yet: any beginning is free
        rows = best[front + top - count + 1 : front + top + 1]
        np.minimum(rows, new[::-1], out=rows)
        if even:
            two, cell = cell, two
        else:
            one[1:-1] = new
    return best[front : front + m + 1]


class Meetings:
    """Verification of (region, item) pairs, many at once."""

    def __init__(self, texts: list[str], items: list[list[str]], pair_text: np.ndarray, pair_item: np.ndarray):
        pad = "\0" * (BAND + 2)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.base = np.cumsum(np.concatenate([[0], sizes + len(pad)]))[:-1] + len(pad)
        self.text = _codes(pad + pad.join(texts) + pad)
        self.end = (self.base + sizes)[pair_text]
        self.base = self.base[pair_text]
        self.item = pair_item
        self.size = np.array([len(w) for w in items], np.int64)
        self.first = np.cumsum(np.concatenate([[0], self.size + 1]))[:-1]
        lengths = np.concatenate([[*map(len, w), 0] for w in items]).astype(np.int64)
        self.start = np.cumsum(np.concatenate([[0], lengths]))[:-1]  # of each word in all items' letters, and their ends
        self.letters = _codes("".join("".join(w) for w in items))
        self.cost = np.repeat(UNIT // np.maximum(lengths, 1), lengths).astype(np.uint16)
        self.cost[self.cost == 0] = 1

    def run(self, pair: np.ndarray, word: np.ndarray, count: np.ndarray, diagonal: np.ndarray, back: bool) -> np.ndarray:
        """(LONGEST + 1, runs): least cost of the next 0, 1, ... words from ``word`` on, or of those before it.

        At most ``count`` words; ``diagonal``: where the item's first letter is
        expected in the pair's text.  Beyond ``count`` the last cost is repeated.
        """
        item = self.item[pair]
        w0 = self.first[item] + word
        steps = np.minimum(np.arange(LONGEST + 1)[:, None], count)
        bounds = self.start[w0 - steps] if back else self.start[w0 + steps]
        here = self.start[w0]
        taken = here - bounds if back else bounds - here
        m = max(1, int(taken[-1].max(initial=1)))
        rows = np.arange(m)[:, None]
        inside = rows < taken[-1]
        at = np.where(inside, here - 1 - rows if back else here + rows, 0)
        letters = np.where(inside, self.letters[at], 0)
        costs = np.where(inside, self.cost[at], 0)
        place = self.base[pair] + diagonal + here - self.start[self.first[item]]
        span = np.arange(-BAND, m + BAND)[:, None]
        where = place - 1 - span if back else place + span
        lo, hi = self.base[pair], self.end[pair]
        text = np.where((where >= lo) & (where < hi), self.text[np.clip(where, 0, len(self.text) - 1)], 1)
        return np.take_along_axis(edit_costs(letters, costs, text), taken, axis=0)


_ALLOWED = np.array([allowed_words(n) for n in range(LONGEST + 1)])
# what an allowed stretch costs at most: LONGER beyond each changed word
_COST_BOUND = np.ceil((_ALLOWED + LONGER * np.floor(_ALLOWED)) * UNIT).astype(np.int64)
# all (words before, words after) a word that make up a stretch
_BEFORE, _AFTER = (np.array(x)[:, None] for x in zip(*[(n - a, a) for n in range(1, LONGEST + 1) for a in range(1, n + 1)]))


def verified(work: Meetings, pairs: list[list[tuple[int, np.ndarray]]], chunk: int = 512) -> dict[int, float]:
    """Share of changed words of each pair that holds.

    ``pairs``: for each pair its meetings as (diagonal, words of the item).  A
    pair holds if a stretch of the item around one of those words stands in the
    text, at most ``DRIFT`` letters off that diagonal, with no more than
    ``allowed_words`` changed.  For a word in the middle the least costs of what
    lies before and after it, each aligned on its own, bound every stretch from
    below; only stretches within the limit go to the exact alignment, and
    what remains are stretches wholly to one side of that word.
    """
    found: dict[int, float] = {}
    sizes = work.size[work.item]
    shortest = np.minimum(SHORTEST, sizes)
    tasks = [(p, diagonal, hits, 0, int(sizes[p])) for p, meetings in enumerate(pairs) for diagonal, hits in meetings]
    while tasks:
        later, exact = [], []
        for k in range(0, len(tasks), chunk):
            part = [t for t in tasks[k : k + chunk] if t[0] not in found]
            if not part:
                continue
            pair, diagonal, word, low, high = (np.array(x, np.int64) for x in zip(*[(p, g, h[len(h) // 2], lo, hi) for p, g, h, lo, hi in part]))
            ahead = work.run(pair, word, np.minimum(LONGEST, high - word), diagonal, False).astype(np.int64)
            behind = work.run(pair, word, np.minimum(LONGEST, word - low), diagonal, True).astype(np.int64)
            fits = (_BEFORE <= word - low) & (_AFTER <= high - word) & (_BEFORE + _AFTER >= shortest[pair])
            spare = np.where(fits, _COST_BOUND[_BEFORE + _AFTER] - behind[_BEFORE[:, 0]] - ahead[_AFTER[:, 0]], -1)
            for r in np.flatnonzero(spare.max(axis=0) >= 0).tolist():
                p, g, _, _, hi = part[r]
                good = np.flatnonzero(spare[:, r] >= 0)
                starts = word[r] - _BEFORE[good[np.argsort(-spare[good, r], kind="stable")], 0]
                exact.append((p, g, list(dict.fromkeys(starts.tolist())), hi))
            for (p, g, hits, lo, hi), w in zip(part, word.tolist()):
                if len(hits) > 1:
                    mid = len(hits) // 2
                    if w - lo >= shortest[p]:
                        later.append((p, g, hits[:mid], lo, w))
                    if mid + 1 < len(hits) and hi - w - 1 >= shortest[p]:
                        later.append((p, g, hits[mid + 1 :], w + 1, hi))
        while exact:
            again = []
            for k in range(0, len(exact), chunk):
                part = [t for t in exact[k : k + chunk] if t[0] not in found]
                if not part:
                    continue
                pair, diagonal, start, high = (np.array(x, np.int64) for x in zip(*[(p, g, s[0], h) for p, g, s, h in part]))
                cost = work.run(pair, start, np.minimum(LONGEST, high - start), diagonal, False)
                changed = changed_words(cost / UNIT)
                words = np.arange(LONGEST + 1)[:, None]
                held = (words >= shortest[pair]) & (words <= high - start) & (changed <= _ALLOWED[:, None])
                share = np.where(held, changed / np.maximum(words, 1), np.inf).min(axis=0)
                for (p, g, s, h), x in zip(part, share.tolist()):
                    if x < math.inf:
                        found[p] = min(x, found.get(p, x))
                    elif len(s) > 1:
                        again.append((p, g, s[1:], h))
            exact = again
        tasks = [t for t in later if t[0] not in found]
    return found


def _meetings(hits: np.ndarray, starts: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Meetings of one pair, (place, word) rows, grouped by diagonals at most ``SPREAD`` letters apart."""
    diagonal = hits[:, 0] - starts[hits[:, 1]]
    order = np.lexsort((hits[:, 1], diagonal))
    diagonal, word = diagonal[order], hits[order, 1]
    out, lo = [], 0
    while lo < len(word):
        hi = int(np.searchsorted(diagonal, diagonal[lo] + SPREAD, side="right"))
        out.append((int(diagonal[lo] + diagonal[hi - 1]) // 2, np.unique(word[lo:hi])))
        lo = hi
    return sorted(out, key=lambda m: -len(m[1]))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 2048):
            batch = whole.slice(k, 2048)
            ids = batch.column(1).to_pylist()
            place = {i: n for n, i in enumerate(dict.fromkeys(ids))}
            firsts = {i: n for n, i in reversed(list(enumerate(ids)))}
            words = [batch.column(3)[firsts[i]].as_py() for i in place]
            starts = [_starts(w) for w in words]
            pair_item = np.array([place[i] for i in ids], np.int64)
            at, word = batch.column(4), batch.column(5)
            pairs = [
                _meetings(np.stack([at[r].values.to_numpy(), word[r].values.to_numpy()], axis=1).astype(np.int64), starts[pair_item[r]])
                for r in range(batch.num_rows)
            ]
            found = verified(Meetings(batch.column(2).to_pylist(), words, np.arange(batch.num_rows), pair_item), pairs)
            if found:
                rows = pa.array(list(found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(list(found.values()))], names=["doc_id", "item_id", "edit_share"]
                )


class SmallIndex:
    """The index and the passages of an item table that is small enough to be sent to every task."""

    def __init__(self, index: pa.Table, passages: pa.Table):
        self.ids = passages["item_id"].to_numpy()
        order = np.argsort(self.ids)
        self.ids, self.words = self.ids[order], passages["words"].take(pa.array(order)).to_pylist()
        self.starts = [_starts(w) for w in self.words]
        hashes = index["hash"].to_numpy()
        by_hash = np.argsort(hashes, kind="stable")
        self.hash = hashes[by_hash]
        self.item = np.searchsorted(self.ids, index["item_id"].to_numpy())[by_hash]
        self.word = index["word"].to_numpy()[by_hash].astype(np.int64)

    def held(self, texts: list[str], at: list[np.ndarray], hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item id, share of changed words) of the pairs that hold."""
        asked = np.concatenate(hashes)
        text = np.repeat(np.arange(len(texts)), list(map(len, hashes)))
        lo = np.searchsorted(self.hash, asked)
        n = np.searchsorted(self.hash, asked, side="right") - lo
        row = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        met = np.unique(np.stack([np.repeat(text, n), self.item[row], np.repeat(np.concatenate(at), n), self.word[row]], axis=1), axis=0)
        if not len(met):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(met[:, :2], axis=0) != 0).any(axis=1)]))
        pair_text, pair_item = met[first, 0], met[first, 1]
        pairs = [_meetings(part[:, 2:], self.starts[i]) for part, i in zip(np.split(met, first[1:]), pair_item)]
        used, pair_item = np.unique(pair_item, return_inverse=True)
        found = verified(Meetings(texts, [self.words[i] for i in used], pair_text, pair_item), pairs)
        rows = np.array(list(found), np.int64)
        return pair_text[rows], self.ids[used[pair_item[rows]]], np.array(list(found.values()))


def leaked_items(documents: DataFrame, items: DataFrame, small_index: int = SMALL_INDEX) -> DataFrame:
    """Documents that hold a passage of an item: doc_id, item_id, edit_share.

    A document holds an item if ``SHORTEST`` to ``LONGEST`` words on end of the
    item's passage (all of a shorter passage) stand in its text with at most
    ``allowed_words`` of them changed (2 of 16, 3 of 24).  The stretch must lie at most
    ``DRIFT`` letters off the diagonal on which a window of it met one of the
    document.  Case, accents, look-alike letters, markup, broken lines and
    punctuation do not count.  ``edit_share`` is the share of changed words of
    the stretch that was found to hold, the least over the document.  Whole texts are searched, however long.
    Null and empty texts or items match nothing, nor does an item whose passage
    is shorter than ``WINDOW`` letters.  Repeated rows give one result.  Either
    side may be empty; further columns are ignored.
    """
    spark = documents.sparkSession
    passages = materialize(item_passages(items))
    index = materialize(passages.mapInArrow(_indexed, "hash bigint, item_id bigint, word int"))
    letters = F.length(F.array_join("words", ""))
    longest = F.aggregate("words", F.lit(0), lambda a, x: F.greatest(a, F.length(x)))
    size = passages.agg(F.max(letters), F.max(longest), F.sum(letters + F.size("words"))).first()
    if size[0] is None:
        return spark.createDataFrame([], _HELD)
    # letters that LONGEST words of any item can take, and their drift
    reach = min(size[0], LONGEST * size[1]) + 2 * BAND + WINDOW
    total = index.count()
    marks = spark.sparkContext.broadcast(Marks.of(index, total).words)  # at most 2 ** MARK_BITS bits
    slim = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    least = lambda held: held.groupBy("doc_id", "item_id").agg(F.min("edit_share").alias("edit_share"))
    if total <= small_index and size[2] <= 16 * small_index:
        # both checked: at most 20 bytes a hash and 32 MB of passages at the default bound
        whole = spark.sparkContext.broadcast(SmallIndex(index.toArrow(), passages.toArrow()))
        return least(widened(slim).mapInArrow(_scan(marks, reach, whole), _HELD))
    regions = materialize(widened(slim).mapInArrow(_scan(marks, reach), _REGIONS))
    hits = regions.select("region", F.inline(F.arrays_zip("at", "hash")))
    # index rows of one hash are few, hits of one hash may be many
    met = salted_join(hits, index, ["hash"], [F.col("region"), F.col("at")], "inner", 4)
    met = met.groupBy("region", "item_id").agg(F.collect_set(F.struct("at", "word")).alias("m"))
    pairs = met.join(regions.select("region", "doc_id", "text"), "region")
    pairs = salted_join(pairs, passages, ["item_id"], [F.col("region")], "inner", 4)
    # few bytes, much work a row: not left to sizes
    pairs = pairs.select("doc_id", "item_id", "text", "words", "m.at", "m.word").repartition(shuffle_partitions(spark))
    return least(pairs.mapInArrow(_verify, _HELD))
