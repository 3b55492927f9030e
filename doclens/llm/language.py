"""Language of a text: a bidirectional gated recurrent network over its bytes, trained here."""

from __future__ import annotations

import random
import string
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclens.llm.common import crc_mod, read, ships

ships(__name__)

UNKNOWN = "und"
# The network reads a text in windows of so many bytes; every byte of the text is in one window.
WINDOW = 64
HIDDEN = 8
# Bounds of the labelled sample that is fitted on: documents of each language, windows of each document.
SAMPLE, WINDOWS_EACH = 400, 8
# Characters of a sampled text that come to the driver, the pieces a longer one gives, groups of the first ranking.
SPAN, PIECES, GROUPS = 1 << 16, 32, 256
PAD = 256
# Windows that run side by side; bounds a task's memory whatever the length of a text.
LANES = 2048
# Bytes of a text that count for nothing against it: half a window.
DOUBT = WINDOW // 2


@dataclass
class Network:
    """Two directions, each with input tables ``x`` (257 x 3H: reset, update, candidate), recurrent
    weights ``u`` (H x 2H), ``v`` (H x H), and an output layer over both states."""

    languages: list[str]
    x: list[np.ndarray]
    u: list[np.ndarray]
    v: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.x, *self.u, *self.v, self.out, self.bias]


def fresh(languages: list[str], hidden: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)

    def draw(*shape: int) -> np.ndarray:
        return rng.normal(0, 0.3, shape).astype(np.float32)

    return Network(
        languages,
        [draw(PAD + 1, 3 * hidden) for _ in range(2)],
        [draw(hidden, 2 * hidden) for _ in range(2)],
        [draw(hidden, hidden) for _ in range(2)],
        draw(2 * hidden, len(languages)),
        np.zeros(len(languages), np.float32),
    )


def _sigmoid(a: np.ndarray) -> np.ndarray:
    a *= 0.5
    np.tanh(a, out=a)
    a += 1
    a *= 0.5
    return a


def _step(h: np.ndarray, x: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
    """One gated step for all lanes: reset r, update z, candidate c."""
    size = h.shape[1]
    gates = _sigmoid(h @ u + x[:, : 2 * size])
    r, z = gates[:, :size], gates[:, size:]
    c = np.tanh((r * h) @ v + x[:, 2 * size :])
    return h + z * (c - h), r, z, c


def states(net: Network, windows: np.ndarray) -> np.ndarray:
    """Hidden states of both directions at every position: (side, position, lane, H).

    As ``_step``, with reset, update and candidate in arrays of their own and no new memory per step.
    """
    lanes, length = windows.shape
    size = net.u[0].shape[0]
    both = np.empty((2, length, lanes, size), np.float32)
    columns = np.ascontiguousarray(windows.T).astype(np.intp)
    r, z, c, x = (np.empty((lanes, size), np.float32) for _ in range(4))
    half = np.float32(0.5)
    for side in range(2):
        # sigmoid(a) = tanh(a / 2) / 2 + 1 / 2, the first halving folded into the weights
        xs = [np.ascontiguousarray(part) for part in np.split(net.x[side], 3, axis=1)]
        ur, uz = (np.ascontiguousarray(part) * half for part in np.split(net.u[side], 2, axis=1))
        xr, xz, xc = xs[0] * half, xs[1] * half, xs[2]
        h = np.zeros((lanes, size), np.float32)
        for t in range(length) if side == 0 else range(length - 1, -1, -1):
            at = columns[t]
            for gate, table, weights in ((r, xr, ur), (z, xz, uz)):
                np.matmul(h, weights, out=gate)
                gate += np.take(table, at, axis=0, out=x, mode="clip")
                np.tanh(gate, out=gate)
                gate *= half
                gate += half
            r *= h
            np.matmul(r, net.v[side], out=c)
            c += np.take(xc, at, axis=0, out=x, mode="clip")
            np.tanh(c, out=c)
            c -= h
            c *= z
            h = np.add(h, c, out=both[side, t])
    return both


def probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    """Label probabilities at every position: (position, lane, language)."""
    both = states(net, windows)
    size = both.shape[3]
    odds = both[0] @ net.out[:size]
    odds += both[1] @ net.out[size:]
    odds += net.bias
    np.clip(odds, -30, 30, out=odds)
    np.exp(odds, out=odds)
    odds /= odds.sum(axis=2, keepdims=True)
    return odds


def gradients(net: Network, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients by backpropagation through time; each position is labelled with its window's label."""
    lanes, length = windows.shape
    size = net.u[0].shape[0]
    trace: list[list[tuple]] = [[], []]
    both = np.zeros((length, lanes, 2 * size), np.float32)
    for side in range(2):
        h = np.zeros((lanes, size), np.float32)
        places = range(length) if side == 0 else range(length - 1, -1, -1)
        for t in places:
            new, r, z, c = _step(h, net.x[side][windows[:, t]], net.u[side], net.v[side])
            trace[side].append((t, h, r.copy(), z.copy(), c))
            both[t, :, side * size : (side + 1) * size] = h = new
    odds = both @ net.out + net.bias
    odds -= odds.max(axis=2, keepdims=True)
    p = np.exp(odds)
    p /= p.sum(axis=2, keepdims=True)
    real = (windows != PAD).T.astype(np.float32)
    count = max(1.0, float(real.sum()))
    lane = np.arange(lanes)
    loss = -float((np.log(p[:, lane, labels] + 1e-9) * real).sum()) / count
    p[:, lane, labels] -= 1
    p *= real[:, :, None] / count
    g_out = np.einsum("tlh,tlk->hk", both, p, optimize=True)
    back = p @ net.out.T
    gx, gu, gv = [], [], []
    for side in range(2):
        x = np.zeros_like(net.x[side])
        u, v = np.zeros_like(net.u[side]), np.zeros_like(net.v[side])
        carry = np.zeros((lanes, size), np.float32)
        for t, h, r, z, c in reversed(trace[side]):
            d = carry + back[t, :, side * size : (side + 1) * size]
            dc = d * z * (1 - c * c)
            dz = d * (c - h) * z * (1 - z)
            drh = dc @ net.v[side].T
            dr = drh * h * r * (1 - r)
            gates = np.concatenate([dr, dz], axis=1)
            u += h.T @ gates
            v += (r * h).T @ dc
            np.add.at(x, windows[:, t], np.concatenate([gates, dc], axis=1))
            carry = d * (1 - z) + drh * r + gates @ net.u[side].T
        gx.append(x)
        gu.append(u)
        gv.append(v)
    return loss, [*gx, *gu, *gv, g_out, p.sum(axis=(0, 1))]


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut byte runs into windows, the last of each padded: (windows, run number of each window)."""
    counts = (ends - starts + WINDOW - 1) // WINDOW
    owner = np.repeat(np.arange(len(starts)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    begin = starts[owner] + (np.arange(len(owner)) - first) * WINDOW
    at = begin[:, None] + np.arange(WINDOW)[None, :]
    inside = at < ends[owner][:, None]
    return np.where(inside, data[np.where(inside, at, 0)] if len(data) else 0, PAD).astype(np.int16), owner


def fit(
    rows: list[tuple[str, str]], steps: int = 200, batch: int = 192, rate: float = 0.03, hidden: int = HIDDEN, seed: int = 5
) -> Network:
    """Train on (text, language) rows with Adam; windows of all languages are drawn equally often.

    At most ``WINDOWS_EACH`` windows of a text are used, evenly spaced. No rows: a network that
    knows no language, for which every text is unknown.
    """
    languages = sorted({language for _, language in rows})
    net = fresh(languages, hidden, seed)
    if not languages:
        return net
    pools: list[list[np.ndarray]] = [[] for _ in languages]
    for text, language in rows:
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        windows, _ = cut(data, np.array([0]), np.array([len(data)]))
        chosen = np.unique(np.linspace(0, max(0, len(windows) - 1), WINDOWS_EACH).astype(int))
        pools[languages.index(language)].append(windows[chosen] if len(windows) else windows)
    lanes = [np.concatenate(pool) for pool in pools]
    usable = [k for k, pool in enumerate(lanes) if len(pool)]
    if not usable:
        return net
    rng = np.random.default_rng(seed)
    held = net.parameters()
    first, second = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held]
    for step in range(1, steps + 1):
        labels = rng.choice(usable, batch)
        windows = np.stack([lanes[k][rng.integers(len(lanes[k]))] for k in labels])
        _, found = gradients(net, windows, labels)
        pace = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for p, g, m, s in zip(held, found, first, second, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def shares(net: Network, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each text has a letter, and the mean probability of each label over all its bytes."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    spoken = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    sizes = np.diff(ends)
    sums = np.zeros((len(texts), max(1, len(net.languages))))
    bounds = [0]
    while bounds[-1] < len(texts):  # so many texts at a time as fill the lanes
        limit = ends[bounds[-1]] + LANES * WINDOW
        bounds.append(max(bounds[-1] + 1, int(np.searchsorted(ends, limit, "right")) - 1))
    for low, high in zip(bounds, bounds[1:]):
        for start in range(int(ends[low]), int(ends[high]) or 1, LANES * WINDOW) if high == low + 1 else [None]:
            begin = ends[low:high] if start is None else np.array([start])
            end = ends[low + 1 : high + 1] if start is None else np.array([min(start + LANES * WINDOW, ends[high])])
            windows, owner = cut(data, begin, np.maximum(begin, end))
            if len(windows) and net.languages:
                p = probabilities(net, windows)
                p *= (windows != PAD).T[:, :, None]
                each = p.sum(axis=0)
                for k in range(each.shape[1]):
                    sums[low:high, k] += np.bincount(owner, each[:, k], minlength=high - low)
    return spoken.astype(bool), np.clip(sums / np.maximum(sizes, 1)[:, None], 0.0, 1.0)


def pooled(net: Network, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Predicted language and its mean probability over all bytes of each text."""
    spoken, means = shares(net, texts)
    best = means.argmax(axis=1)
    score = means[np.arange(len(means)), best]
    known = spoken & bool(net.languages)
    names = [net.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
    return names, np.where(known, score, 0.0)


def recognised(net: Network, texts: pa.Array) -> np.ndarray:
    """The mean probability over all bytes of each text that they are in a learnt language, whichever;
    0 without a letter. Quoted passages in another learnt language do not lower it.

    A text counts as if ``DOUBT`` recognised bytes stood before it, as a few bytes show too little."""
    spoken, means = shares(net, texts)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    strange = means[:, net.languages.index(UNKNOWN)] * sizes / (sizes + DOUBT)
    return np.where(spoken, 1.0 - strange, 0.0)


def fit_with_rejects(rows: list[tuple[str, str]], steps: int = 300, hidden: int = 16) -> tuple[Network, float]:
    """A network that has learnt ``rejects`` as well, and the least ``recognised`` to accept.

    Every fifth row of a language is held out, so rows come in an order that does not depend on what
    they hold. The bound is midway between what 99 of 100 held-out rows reach and what 99 of 100 fresh
    texts of junk stay below; 0.5 where a side has no rows."""
    places: Counter[str] = Counter()
    held, fitted = [], []
    for text, language in rows:
        places[language] += 1
        (fitted if places[language] % 5 else held).append((text, language))
    net = fit(fitted + rejects(fitted), steps, hidden=hidden)
    clean = [spread(text, WINDOW * 64) for text, language in held if language != UNKNOWN]
    junk = [text for text, language in rejects(held, seed=7, shuffled=False) if language == UNKNOWN]
    if not clean or not junk or UNKNOWN not in net.languages:
        return net, 0.5
    low, high = np.quantile(recognised(net, pa.array(clean)), 0.01), np.quantile(recognised(net, pa.array(junk)), 0.99)
    return net, float(low + high) / 2


def rejects(
    rows: list[tuple[str, str]], each: int = 60, seed: int = 6, shuffled: bool = True
) -> list[tuple[str, str]]:
    """Rows that teach ``fit`` what no learnt language looks like, labelled ``UNKNOWN``, and repeated
    words and passages of the given texts under their own label, which are sound.

    Of each kind ``each`` texts: printable characters, base64, hexadecimal digits, numbers with short
    names, markup, letters of a script that the given texts do not use, accented letters, and the
    characters of the given texts in random order (letters of a known script, another language), which
    ``shuffled`` leaves out."""
    texts = [(text, language) for text, language in rows if text.strip() and language != UNKNOWN]
    if not texts:
        return []
    rng = random.Random(seed)
    length = WINDOW * WINDOWS_EACH
    used = {ord(c) >> 7 for text, _ in texts for c in set(text[:length])}
    foreign = [page for page in range(5, 0x1F6) if page not in used and not 0x1B0 <= page < 0x1C0]
    lower = string.ascii_lowercase

    def drawn(letters: Sequence[str], low: int, high: int) -> str:
        return "".join(rng.choices(letters, k=rng.randint(low, high)))

    def until(piece: Callable[[], str]) -> str:
        made = ""
        while len(made) < length:
            made += piece()
        return made[:length]

    def field() -> str:
        number = drawn(string.digits, 1, 8)
        kind = rng.randrange(4)
        name = drawn(lower, 0, 3)
        return [f"{number}.{rng.randrange(999999)}", f"{name}{number}", f"-{number}e{rng.randrange(30)}", name][kind]

    def tag(names: list[str]) -> str:
        name, inner = rng.choice(names), rng.choice(["", drawn(string.digits, 1, 6), drawn(string.printable[:62], 1, 8)])
        value = rng.choice(["", f' {rng.choice(names)}="{drawn(string.printable[:64], 1, 9)}"'])
        return rng.choice([f"<{name}{value}>{inner}</{name}>", f"<{name}{value}/>", f"<{name}{value}>{inner}"])

    def scripted() -> str:
        page = rng.choice(foreign) if foreign else 0x20
        letters = [chr(rng.randrange(page << 7, (page + 1) << 7)) for _ in range(rng.choice([12, 30, 128]))]
        low, high = rng.choice([(2, 9), (2, 9), (20, 60)])
        return until(lambda: drawn(letters, low, high) + rng.choice([" ", " ", ". "]))[: length // 2]

    accented = [chr(c) for c in range(0xA1, 0x180)]
    known = ["a", "b", "br", "class", "div", "em", "head", "href", "id", "img", "li", "p", "span", "src", "style", "td", "tr"]
    found: list[tuple[str, str]] = []
    for _ in range(each):
        parting, joint = rng.choice([",", ";", " ", "\t", "|", ", "]), rng.choice(["", "\n", " "])
        digits = rng.choice(["0123456789abcdef", "0123456789ABCDEF"])
        line = rng.choice([4, 8, 32, 64, 76, length])
        names = known + [drawn(lower, 1, 8) for _ in range(6)]
        order = list(rng.choice(texts)[0][:length])
        rng.shuffle(order)
        junk = [
            drawn(string.printable[:94], length, length),
            until(lambda line=line: drawn(string.ascii_letters + string.digits + "+/", line, line) + rng.choice(["\n", ""])),
            until(lambda line=line, digits=digits: drawn(digits, line, line) + rng.choice(["", "", " ", "\n"])),
            until(lambda parting=parting: field() + parting),
            until(lambda joint=joint, names=names: tag(names) + joint),
            scripted(),
            until(lambda: drawn(accented, 1, 12) + rng.choice([" ", ""])),
            "".join(order),
        ]
        found += [(text, UNKNOWN) for text in (junk if shuffled else junk[:-1])]
    for text, language in rng.sample(texts, min(len(texts), 2 * each)):
        words = text.split()
        at = rng.randrange(len(words))
        passage = " ".join(words[at : at + rng.choice([1, 1, 2, 3, 8])]) + " "
        for said in (passage, passage.lower(), passage.upper()):
            found.append((said * (1 + length // len(said)), language))
    return found


def spread(text: str, length: int, pieces: int = PIECES) -> str:
    """A text of at most ``length`` characters whole; of a longer one as many, in equal pieces evenly
    spaced from its start to its end."""
    if len(text) <= length:
        return text
    size = length // pieces
    return "".join(text[at : at + size] for at in ((len(text) - size) * i // (pieces - 1) for i in range(pieces)))


def spread_column(text: Column, length: int, pieces: int = PIECES) -> Column:
    """``spread`` of a column, worked out before the text leaves its task."""
    size, free = length // pieces, F.length(text).cast("long") - length // pieces
    starts = [F.floor(free * i / (pieces - 1)).cast("int") + 1 for i in range(pieces)]
    return F.when(F.length(text) <= length, text).otherwise(F.concat(*[text.substr(at, F.lit(size)) for at in starts]))


def labelled_sample(
    docs: DataFrame,
    sample: int = SAMPLE,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    span: int = SPAN,
) -> list[tuple[str, str]]:
    """At most ``sample`` (text, language) rows of each language, those of the smallest key hashes.

    Rows whose key, text or language is null, or whose text is empty, teach nothing. Keys are ranked in
    two steps, within ``GROUPS`` groups of input partitions of a language and then among the
    ``GROUPS * sample`` that are left, each with a partial limit before its shuffle, so no task's input
    grows with the rows. The chosen texts are fetched; ``fit`` uses ``WINDOWS_EACH`` windows of a text, so
    one of over ``span`` characters comes as that many in pieces ``spread`` over its whole length.
    """
    usable = docs.filter(F.col(key).isNotNull() & F.col(lang).isNotNull() & (F.octet_length(text) > 0))
    ids = usable.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), (F.spark_partition_id() % GROUPS).alias("_group"))
    for names in (["_lang", "_group"], ["_lang"]):
        order = Window.partitionBy(*names).orderBy(F.xxhash64("_key"), "_key")
        ids = ids.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= sample)
    chosen = F.broadcast(ids.select("_key", "_rank"))
    rows = usable.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang")).join(chosen, "_key")
    rows = rows.select(spread_column(F.col("_text"), span).alias("_text"), "_lang", "_rank")
    return [(r["_text"], r["_lang"]) for r in rows.orderBy("_lang", "_rank", "_text").collect()]


def predict(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row, from the bytes of its whole text, without a shuffle.

    Null texts and texts without a letter are ``und`` with score 0. Repeated rows are judged alike, a
    null key is kept, other columns are not read.
    """
    narrow = docs.select(F.col(key), F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = pooled(net, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [key, "lang_pred", "score"],
            )

    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, net: Network, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a pooled probability of ``least``;
    with a network that has learnt ``rejects``, those ``recognised`` with it.

    Where the network has learnt no language, only texts without a letter go."""
    if not set(net.languages) - {UNKNOWN}:
        return docs.filter(F.col(text).rlike(r"\p{L}"))

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        if UNKNOWN in net.languages:
            return pa.array(recognised(net, texts) >= least, pa.bool_())
        names, scores = pooled(net, texts)
        return pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_())

    return docs.filter(known(F.col(text)))


def query(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 3) == 1
    net = fit(labelled_sample(docs.filter(~held_out)))
    return predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
