"""Language ID by a linear-chain conditional random field over the words of a text.

A word is a maximal run of letters A-Z (lower-cased) and bytes beyond ASCII. Its
features are hashed into 2^FEATURE_BITS cells: the word itself (the learned
lexicon), its first and last one to four bytes, and its byte bigrams and
trigrams with a mark at both ends. A label's score is the sum of its weights of
the features, and learned transition weights join the labels of neighbours, so
a word in doubt follows its surroundings and a switch costs evidence.
Forward-backward gives each word's probabilities; a text's are their means.

The field is fitted in one task on a bounded sample of texts: about
SAMPLE_ROWS rows of the MAX_LABELS most frequent labels, an even share of each,
and of each text at most RUNS runs of RUN words spread over all of it. Every
other run of the fit is spliced from two texts, so transitions see switches.
Prediction covers all words of all texts.

Forward-backward is exact on a text of any length: texts are cut in spans of
SPAN words; all spans advance together, each from every label at once, and the
spans' matrices are then chained.

Defined cases: a null text and one without a letter are `und` with score 0; a
text whose letters are in no training text still gets a label, by its n-grams;
without labelled rows every text is `und`; equal scores go to the label first in
order; a null doc_id is no part of held_out; repeated rows each get a row, and
count once in the sample; an empty table gives no rows.
doc_id may be of any type; input columns pass through, those named as a result
are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .quality_fm import held_out
from .words import LOWER, mix, parts

FEATURE_BITS = 16
MAX_LABELS = 64
SAMPLE_ROWS = 6_000
RUNS = 3
RUN = 24
EPOCHS = 4
SPAN = 64
#: Bytes of text whose words are held at a time; a longer text is held whole, 4 bytes a word and label.
SLICE_BYTES = 1 << 19
UNKNOWN = "und"
_CELL = np.uint64(64 - FEATURE_BITS)
#: Values of the kinds of features: the word, an affix, the n-grams together.
WORD_VALUE, AFFIX_VALUE, GRAM_VALUE = 1.0, 0.5, 1.5

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of each word, and for each row the number of its first word; ends are the rows' offsets."""
    inside = _INSIDE[data]
    before = np.r_[False, inside[:-1]] if len(data) else inside
    begins, stops = inside & ~before, np.r_[~inside[1:], True] & inside if len(data) else inside
    cut = ends[(ends > 0) & (ends < len(data))]
    begins[cut] = inside[cut]
    stops[cut - 1] = inside[cut - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return start, stop, np.searchsorted(start, ends)


def features(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells and values of the features of each word, laid end to end, and where each word's begin."""
    n, size = len(start), stop - start
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.int64)
    # the words' bytes with a mark (1) before and after each
    wide = size + 2
    first = np.cumsum(wide) - wide
    at = np.arange(int(wide.sum())) - np.repeat(first, wide)
    place = np.repeat(start, wide) + at - 1
    edge = (at == 0) | (at == np.repeat(wide, wide) - 1)
    x = np.where(edge, 1, LOWER[data[np.clip(place, 0, len(data) - 1)]]).astype(np.uint64)
    owner = np.repeat(np.arange(n), wide)
    word, cell, value = [], [], []

    def add(who, what, how):
        word.append(who)
        cell.append((mix(what) >> _CELL).astype(np.int32))
        value.append(np.broadcast_to(np.asarray(how, np.float32), len(who)))

    with np.errstate(over="ignore"):
        # kinds stand in the upper bits: n-grams below 2^24, affixes with length and side
        two = x[:-1] << np.uint64(8) | x[1:]
        in_two = owner[:-1] == owner[1:]
        three = two[:-1] << np.uint64(8) | x[2:]
        in_three = in_two[:-1] & in_two[1:]
        grams = size + 1 + size
        share = GRAM_VALUE / np.sqrt(grams)
        add(owner[:-1][in_two], two[in_two] + np.uint64(2 << 32), share[owner[:-1][in_two]])
        add(owner[:-2][in_three], three[in_three] + np.uint64(3 << 32), share[owner[:-2][in_three]])
        head, tail = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for k in range(1, 5):
            long = size >= k
            who = np.flatnonzero(long)
            head[who] = head[who] << np.uint64(8) | x[first[who] + k]
            tail[who] |= x[first[who] + size[who] + 1 - k] << np.uint64(8 * (k - 1))
            add(who, head[who] + np.uint64((16 + k) << 32), AFFIX_VALUE)
            add(who, tail[who] + np.uint64((32 + k) << 32), AFFIX_VALUE)
        power = mix((at + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        add(np.arange(n), mix(np.add.reduceat(x * power, first)) + size.astype(np.uint64), WORD_VALUE)
    word = np.concatenate(word)
    order = np.argsort(word, kind="stable")
    counts = np.bincount(word, minlength=n)
    return np.concatenate(cell)[order], np.concatenate(value)[order], np.cumsum(counts) - counts


@dataclass
class Field:
    """labels; weights (cells, labels); bias and start (labels); moves (label, next label)."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    start: np.ndarray
    moves: np.ndarray

    def scores(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Emission scores of words; equal words of the slice are scored once."""
        if not len(start):
            return np.zeros((0, len(self.labels)), np.float32)
        key = word_keys(data, start, stop)
        _, one, where = np.unique(key, return_index=True, return_inverse=True)
        cell, value, first = features(data, start[one], stop[one])
        return (np.add.reduceat(self.weights[cell] * value[:, None], first, axis=0) + self.bias)[where]

    def marginals(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each word's label probabilities; first: where each text's words begin, and the end."""
        return chain(scores, first, self.start, self.moves)


def word_keys(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    size = stop - start
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        x = LOWER[data[np.repeat(start, size) + at]].astype(np.uint64) + np.uint64(1)
        return mix(np.add.reduceat(x * mix((at + 1).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), first) + size.astype(np.uint64))


def _exp(x: np.ndarray) -> np.ndarray:
    return np.exp(x - x.max(-1, keepdims=True))


def _unit(x: np.ndarray, axes) -> np.ndarray:
    return x / x.sum(axes, keepdims=True)


def chain(scores: np.ndarray, first: np.ndarray, start: np.ndarray, moves: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Forward-backward over many sequences; those of row i are first[i]:first[i + 1].

    With p the emissions and M the moves, forward is f[t] = (f[t-1] M) p[t] and
    backward b[t] = M (p[t+1] b[t+1]). A span's product of these matrices comes
    from advancing all labels at once; chaining the products gives what enters
    each span from the left and from the right. Every vector is scaled to sum 1.
    """
    k = scores.shape[1]
    sizes = np.diff(first)
    some = np.flatnonzero(sizes)
    out = np.zeros((len(scores), k))
    if not len(some):
        return out
    move = np.exp(moves - moves.max())
    count = -(-sizes[some] // span)
    owner = np.repeat(np.arange(len(some)), count)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[:-1][some][owner] + turn * span
    length = np.minimum(span, first[1:][some][owner] - begin)
    order = np.argsort(-length, kind="stable")  # the spans that still run stand in front
    begin, length = begin[order], length[order]
    running = np.searchsorted(-length, -np.arange(1, span + 1), side="right")
    emit = _exp(scores.astype(np.float64))
    # the matrix of a span: from the label before it to the label of its last word
    through = np.broadcast_to(np.eye(k), (len(begin), k, k)).copy()
    for t in range(int(length[0])):
        m = running[t]
        through[:m] = _unit(through[:m] @ move * emit[begin[:m] + t][:, None, :], (1, 2))
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    # chain the spans of a text, all texts together
    spans_at = np.cumsum(count) - count
    left, right = np.empty((len(begin), k)), np.empty((len(begin), k))
    # what stands before the first word: start weights, as a vector v with v M = start
    entering = np.exp(start - start.max())
    by_count = np.argsort(-count, kind="stable")
    more = np.searchsorted(-count[by_count], -np.arange(1, int(count.max()) + 1), side="right")
    row, v = spans_at[by_count], None
    for s in range(int(count.max())):
        m = more[s]
        at = back[row[:m] + s]
        if s == 0:
            left[at] = 0.0  # marks a first span
            f = entering * emit[begin[at]]
            v = _unit(f, 1)
            v = _finish(v, begin[at], length[at], emit, move)
        else:
            left[at] = v[:m]
            v = _unit((v[:m, None, :] @ through[at])[:, 0], 1)
    last = back[spans_at + count - 1]
    right[last] = 1.0
    reach = np.flatnonzero(count > 1)
    reach = reach[np.argsort(-count[reach], kind="stable")]
    v = np.ones((len(reach), k))
    for s in range(1, int(count.max())):
        m = int(np.searchsorted(-count[reach], -(s + 1), side="right"))
        at = back[spans_at[reach[:m]] + count[reach[:m]] - s]
        v = _unit((through[at] @ v[:m, :, None])[:, :, 0], 1)
        right[back[spans_at[reach[:m]] + count[reach[:m]] - s - 1]] = v
    # forward and backward inside the spans from what enters them
    forward = np.empty((len(scores), k))
    f = np.empty((len(begin), k))
    opening = ~left.any(1)
    for t in range(int(length[0])):
        m = running[t]
        p = emit[begin[:m] + t]
        if t == 0:
            f = np.where(opening[:, None], entering, left @ move) * p
        else:
            f = f[:m] @ move * p
        f = _unit(f, 1)
        forward[begin[:m] + t] = f
    b = right.copy()
    for t in range(int(length[0]) - 1, -1, -1):
        m = running[t]
        at = begin[:m] + t
        out[at] = _unit(forward[at] * b[:m], 1)
        # only spans with a word at t go back by it; the others wait with what enters them
        b[:m] = _unit((emit[at] * b[:m]) @ move.T, 1)
    return out


def _finish(v, begin, length, emit, move):
    """The forward vector at the last word of first spans, from that at their first word."""
    order = np.argsort(-length, kind="stable")
    x, at, n = v[order], begin[order], length[order]
    for t in range(1, int(n[0])):
        m = int(np.searchsorted(-n, -(t + 1), side="right"))
        x[:m] = _unit(x[:m] @ move * emit[at[:m] + t], 1)
    out = np.empty_like(v)
    out[order] = x
    return out


def _pairwise(scores, start, moves):
    """Marginals of words and of neighbours, for sequences of one length: scores (rows, words, labels)."""
    n, t, k = scores.shape
    move, emit = np.exp(moves), _exp(scores.astype(np.float64))
    f, b = np.empty((t, n, k)), np.ones((t, n, k))
    f[0] = _unit(np.exp(start) * emit[:, 0], 1)
    for i in range(1, t):
        f[i] = _unit(f[i - 1] @ move * emit[:, i], 1)
    for i in range(t - 2, -1, -1):
        b[i] = _unit((emit[:, i + 1] * b[i + 1]) @ move.T, 1)
    one = _unit(f * b, 2).transpose(1, 0, 2)
    two = np.zeros((k, k))
    for i in range(1, t):
        x = f[i - 1][:, :, None] * move * (emit[:, i] * b[i])[:, None, :]
        two += _unit(x, (1, 2)).sum(0)
    return one, two


def fit(labels: list[str], label: np.ndarray, cell: np.ndarray, value: np.ndarray, first: np.ndarray, run: int = RUN, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.05, decay: float = 1e-6, seed: int = 11) -> Field:
    """Adam on the likelihood of label sequences.

    Runs of `run` words: the words of run r are r * run to (r + 1) * run, all of label[r]; word i has the features first[i]:first[i + 1].
    """
    rng = np.random.default_rng(seed)
    k, cells = len(labels), 1 << FEATURE_BITS
    shape = [(cells, k), (k,), (k,), (k, k)]
    at = [np.zeros(s, np.float32) for s in shape]
    slots = [[np.zeros(s, np.float32) for s in shape] for _ in range(2)]
    step, runs = 0, len(label)
    for _ in range(epochs):
        order = rng.permutation(runs)
        for i in range(0, runs, batch):
            own = order[i : i + batch]
            other = rng.integers(0, runs, len(own))
            # every other row goes over to another text's words at some word
            edge = np.where(rng.random(len(own)) < 0.5, rng.integers(1, run, len(own)), run)
            over = np.arange(run) >= edge[:, None]
            word = np.where(over, other[:, None], own[:, None]) * run + np.arange(run)
            y = np.where(over, label[other][:, None], label[own][:, None])
            flat = word.ravel()
            size = first[flat + 1] - first[flat]
            starts = np.cumsum(size) - size
            pick = np.arange(int(size.sum())) - np.repeat(starts, size) + np.repeat(first[flat], size)
            c, v = cell[pick], value[pick]
            scores = np.add.reduceat(at[0][c] * v[:, None], starts, axis=0) + at[1]
            one, two = _pairwise(scores.reshape(len(own), run, k), at[2], at[3])
            truth = np.eye(k)[y]
            wrong = (one - truth) / len(own)
            each = wrong.reshape(-1, k)
            spread = np.repeat(each, size, axis=0) * v[:, None]
            pairs = np.bincount((y[:, :-1] * k + y[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
            grads = [np.stack([np.bincount(c, spread[:, j], cells) for j in range(k)], 1), each.sum(0), wrong[:, 0].sum(0), (two - pairs) / len(own)]
            step += 1
            for p, g, a, b in zip(at, grads, *slots, strict=True):
                g = (g + decay * p).astype(np.float32)
                a += np.float32(0.1) * (g - a)
                b += np.float32(0.001) * (g * g - b)
                p -= np.float32(rate / (1 - 0.9**step)) * a / (np.sqrt(b / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    return Field(labels, *at)


def _text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    return np.frombuffer((texts.buffers()[2] if n else None) or b"", np.uint8), ends


def _sample_rows(batches):
    """The features of at most RUNS runs of RUN words of each text, spread evenly over it; a shorter text repeats its words."""
    for b in parts(batches, 200):
        data, ends = _text_bytes(b.column("text"))
        rows = []
        for i, (p, q) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            raw = data[p:q]
            start, stop, _ = bounds(raw, np.array([0, len(raw)]))
            if not len(start):
                continue
            runs = min(RUNS, -(-len(start) // RUN))
            for r in range(runs):
                at = (r * max(len(start) - RUN, 0) // max(runs - 1, 1) + np.arange(RUN)) % len(start)
                cell, value, first = features(raw, start[at], stop[at])
                rows.append((b.column("_y")[i].as_py(), cell, value, np.r_[first, len(cell)].astype(np.int32)))
        if rows:
            y, cell, value, first = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(cell, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32())), pa.array(first, pa.list_(pa.int32()))], names=["y", "cell", "value", "first"])


def _fit_table(names: list[str]):
    def run(t: pa.Table) -> pa.Table:
        """The field of the sampled runs, in one row."""
        arrays = lambda c: [np.asarray(x.values) for x in t.column(c)]
        cells, firsts = arrays("cell"), arrays("first")
        # tasks hand in their runs in any order
        order = sorted(range(len(cells)), key=lambda i: (t.column("y")[i].as_py(), cells[i].tobytes()))
        size = np.array([len(cells[i]) for i in order])
        before = np.cumsum(size) - size
        first = np.r_[np.concatenate([firsts[i][:-1] + d for i, d in zip(order, before, strict=True)]), size.sum()]
        values = arrays("value")
        f = fit(names, np.asarray(t.column("y"))[order], np.concatenate([cells[i] for i in order]), np.concatenate([values[i] for i in order]), first)
        return pa.table({c: pa.array([x.ravel()], pa.list_(pa.float32())) for c, x in (("weights", f.weights), ("bias", f.bias), ("start", f.start), ("moves", f.moves))})

    return run


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Field:
    """The field of docs (doc_id, text, lang), learned from rows that aren't held out."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LABELS).collect()
    names = sorted(r.lang for r in counts)
    if not names:
        return Field([], *(np.zeros(s, np.float32) for s in ((1 << FEATURE_BITS, 0), 0, 0, (0, 0))))
    # rows below a bound on a hash: an even share of each label, give or take the root of it, without a sort of texts
    share = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, min(1.0, sample_rows / len(names) / r["count"]))))
    dice = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    number = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i)))
    # a row that is repeated without end counts once
    picked = known.where(dice < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0))).select("doc_id", F.element_at(number, F.col("lang")).alias("_y"), "text").dropDuplicates()
    runs = picked.mapInArrow(_sample_rows, "y int, cell array<int>, value array<float>, first array<int>")
    got = runs.groupBy().applyInArrow(_fit_table(names), "weights array<float>, bias array<float>, start array<float>, moves array<float>").first()
    k = len(names)
    if got is None:  # no labelled text has a word
        return Field([], *(np.zeros(s, np.float32) for s in ((1 << FEATURE_BITS, 0), 0, 0, (0, 0))))
    w, b, s, m = (np.array(x, np.float32) for x in got)
    return Field(names, w.reshape(-1, k), b, s, m.reshape(k, k))


def _slices(ends: np.ndarray):
    at, n = 0, len(ends) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1)
        yield at, to
        at = to


def _label(shared):
    def run(texts):
        """Of each row: (label number or -1, score, words, switches); and (row, start, stop, probabilities of each word) of each slice."""
        f = shared.value
        data, ends = _text_bytes(texts)
        for a, b in _slices(ends):
            raw, own = data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
            start, stop, first = bounds(raw, own)
            scores = np.concatenate([f.scores(raw, start[i : i + SLICE_BYTES // 4], stop[i : i + SLICE_BYTES // 4]) for i in range(0, max(len(start), 1), SLICE_BYTES // 4)])
            yield a, b, raw, own, start, stop, first, f.marginals(scores, first)

    return run


def _document_rows(shared):
    label = _label(shared)

    def run(batches):
        f = shared.value
        for b in parts(batches):
            n = b.num_rows
            best, score, words, switches = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            if f.labels:
                for a, z, _, _, _, _, first, p in label(b.column("text")):
                    words[a:z] = np.diff(first)
                    some = np.flatnonzero(words[a:z])
                    if len(some):
                        mean = np.add.reduceat(p, first[some], axis=0) / words[a:z][some][:, None]
                        best[a:z][some], score[a:z][some] = mean.argmax(1), mean.max(1)
                        top = p.argmax(1)
                        change = np.r_[False, top[1:] != top[:-1]]
                        change[first[some]] = False
                        switches[a:z][some] = np.add.reduceat(change.astype(np.int64), first[some])
            letter = np.asarray(pc.fill_null(pc.match_substring_regex(b.column("text"), r"\pL"), False))
            known = letter & (best >= 0)
            names = np.array([*f.labels, UNKNOWN], object)
            out = [pa.array(names[np.where(known, best, len(f.labels))], pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0), pa.float64()), pa.array(words, pa.int64()), pa.array(np.where(known, switches, 0), pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*b.schema.names, "lang_pred", "score", "n_words", "n_switches"])

    return run


def predict(docs: DataFrame, field: Field) -> DataFrame:
    """docs with lang_pred, score (its mean probability over the words), n_words and n_switches (neighbours with different labels)."""
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    named = T.StructType.fromDDL("lang_pred string, score double, n_words long, n_switches long")
    d = docs.drop(*named.fieldNames())
    return d.mapInArrow(_document_rows(shared), T.StructType(d.schema.fields + named.fields))


def _span_rows(shared):
    label = _label(shared)

    def run(batches):
        names = np.array(shared.value.labels, object)
        for b in parts(batches):
            for a, z, raw, own, start, stop, first, p in label(b.column("text")) if len(names) else ():
                top = p.argmax(1)
                row = np.repeat(np.arange(z - a), np.diff(first))
                begin = np.flatnonzero(np.r_[True, (top[1:] != top[:-1]) | (row[1:] != row[:-1])]) if len(top) else np.zeros(0, np.int64)
                if not len(begin):
                    continue
                end = np.r_[begin[1:], len(top)] - 1
                # bytes that open a character, counted up to each place
                opened = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
                at = own[row[begin]]
                sure = np.add.reduceat(p[np.arange(len(top)), top], begin) / (end - begin + 1)
                out = [b.column("doc_id").take(pa.array(a + row[begin])), pa.array(opened[start[begin]] - opened[at], pa.int64()), pa.array(opened[stop[end]] - opened[at], pa.int64()), pa.array(end - begin + 1, pa.int64()), pa.array(names[top[begin]], pa.string()), pa.array(sure, pa.float64())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "end", "n_words", "lang", "score"])

    return run


def language_spans(docs: DataFrame, field: Field) -> DataFrame:
    """The runs of words of one label: doc_id, start and end (code points, end exclusive), n_words, lang, score. Words in scripts without case or blanks are long ones."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_span_rows(shared), f"doc_id {kind}, start long, end long, n_words long, lang string, score double")


def op11_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = predict(docs.select("doc_id", "text"), train(docs))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
