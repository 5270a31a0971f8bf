"""Near-duplicates by SetSketch registers.

A document's set is its distinct shingles of words. Each shingle is a Poisson process over M registers; a register keeps the earliest
arrival, truncated to an exponentially spaced scale (K = floor(1 - log_BASE(t / A))), so registers of unions are maxima and two sets
agree in a register with about their Jaccard similarity. Bands of ROWS registers are hashed to find candidates. A pair's counts of
greater, less and equal registers give the likelihood of its similarity; pairs whose likelihood at the threshold or above is far below
the best are passed over. So are pairs whose parity sketches (a bit for each place, the parity of the shingles there) differ in more
bits than two sets at the threshold can differ in shingles, which is certain. What remains is verified on the full sets.

Every band's least document is its hub: all members are held against it first and components are formed. Only members that did not
reach their hub's component are then held against the other members of the hub's bands, once for all bands of a hub, in bounded blocks:
first each block gives a forest of its likely pairs, no more pairs than rows, and when those are verified, the likely pairs that still
lie between components, for which only rows that had a likely pair before are met again. A crowded hub, of more rows than a block,
keys its rows by two bands: rows of two or more of its bands stay together, those of one meet under each second crowded hub that they
have. So no group's pairs are all formed, and every pair that shares two bands, or one that is not crowded, is either verified, ruled
out, or already in one component. With 40 bands of 4 registers a pair at similarity 0.8 shares fewer than two with probability 2e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyspark.llm.common import discard, slices, store, work_for
from rallyspark.llm.components import components

M, ROWS = 160, 4
BANDS = M // ROWS
BASE, A = 1.03, 20.0
WORDS, PERCENT = 2, 80
#: Log-likelihood by which a similarity at the threshold may fall behind the best one.
SLACK = 16.0
#: Members verified in one task for a hub, and rows of a block.
SHARE, SIDE = 200, 1024
#: Least places of a parity sketch.
MIN_BITS = 512
#: Mark of a pair among the rows that blocks give, beside the roles of askers (0) and members (1).
_PAIR = 2
_FILL = np.log(M) + 8
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_STEP, _BACK = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_TABLE[65:91] = _TABLE[97:123]  # A-Z count as a-z
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 17)
        for i, base in enumerate((_STEP, _BACK)):
            steps = np.full(size, base)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def _word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word: a random polynomial of its bytes, then mixed."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    word = ~_SPACE[raw]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[raw] * up[: len(raw)], dtype=np.uint64)])
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; of the whole sequence where it has fewer words; none without words."""
    if not text:
        return np.empty(0, np.uint64)
    hashes = np.concatenate([_word_hashes(part) for part in slices(text)])
    if not len(hashes):
        return hashes
    take = min(words, len(hashes))
    out = np.full(len(hashes) - take + 1, np.uint64(take))
    for i in range(take):
        out = _mix(out * _GOLD + hashes[i : len(hashes) - take + 1 + i])
    return np.unique(out)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set (row of M); zeros for an empty set."""
    sizes = np.array(list(map(len, sets)), np.int64)
    first = np.full(len(sets) * M, np.inf)
    todo, reach = np.flatnonzero(sizes), _FILL
    while len(todo):
        doc = np.repeat(todo, sizes[todo])
        state = np.concatenate([sets[i] for i in todo])
        limit, t = reach / sizes[doc], np.zeros(len(doc))
        while len(doc):
            state = state + _GOLD
            h = _mix(state)
            t = t - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / M
            live = t <= limit
            doc, state, limit, t, h = doc[live], state[live], limit[live], t[live], h[live]
            np.minimum.at(first, doc * M + (_mix(h) % np.uint64(M)).astype(np.int64), t)
        todo = todo[np.isinf(first.reshape(-1, M)[todo]).any(1)]
        reach *= 2  # an unfilled register: the same arrivals again, and later ones
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(first / A) / np.log(BASE))
    return np.clip(np.where(np.isinf(first), 0, k), 0, 65535).astype(np.uint16).reshape(-1, M)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    packed = np.ascontiguousarray(registers.reshape(-1, BANDS, ROWS)).view(np.uint64)[:, :, 0]
    return _mix(packed + np.arange(BANDS, dtype=np.uint64) * _GOLD).view(np.int64)


def plausible(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float = PERCENT / 100) -> np.ndarray:
    """Whether a similarity of at least ``least`` is within SLACK of the best log-likelihood, given the registers' joint counts."""
    n_a, n_b = n_a.astype(np.float64), n_b.astype(np.float64)
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)[None, :] * top[:, None]

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    more, fewer = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    score = greater[:, None] * np.log(more) + less[:, None] * np.log(fewer) + equal[:, None] * np.log(np.maximum(1 - more - fewer, 1e-12))
    high = np.where(grid >= least - 1e-9, score, -np.inf)
    return (top >= least - 1e-9) & (np.maximum(high.max(1), score[:, -1]) >= score.max(1) - SLACK)


def _counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    greater, less = (a > b).sum(1), (a < b).sum(1)
    return greater, less, M - greater - less


def parity(hashes: np.ndarray) -> bytes:
    """Parity sketch of a set: bit h mod m is the parity of the shingles there, m a power of two of at least twice the set's size."""
    m = max(MIN_BITS, 1 << int(2 * max(len(hashes), 1) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64-bit words as sketches of fewer places."""
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def _words(sketches_: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches_), np.uint64).reshape(len(sketches_), -1)


def most_apart(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Most shingles in which two sets at the threshold can differ."""
    return (n_a + n_b) * (100 - percent) // (100 + percent)


def near_enough(a: list[bytes], b: list[bytes], n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the parity sketches of each pair allow the threshold: they differ in at most as many bits as the sets in shingles."""
    out = np.zeros(len(a), bool)
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for la, lb in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes == (la, lb)).all(1))
        width = min(la, lb) // 8
        apart = np.bitwise_count(_folded(_words([a[i] for i in at]), width) ^ _folded(_words([b[i] for i in at]), width)).sum(1)
        out[at] = apart <= most_apart(n_a[at], n_b[at], percent)
    return out


def _registers(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, M)


def _sketched(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    work_for("neardup")
    for batch in batches:
        for i in range(0, len(batch), 200):
            part = batch.iloc[i : i + 200]
            sets = [shingles(t, words) for t in part["text"]]
            sums = [(int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(_mix(s)))) if len(s) else (0, 0) for s in sets]
            signed = lambda j: np.array([x[j] for x in sums], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "n": list(map(len, sets)), "set_a": signed(0), "set_b": signed(1), "registers": [r.tobytes() for r in sketches(sets)], "parity": [parity(s) for s in sets]})


def sketch(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n (set size), set_a and set_b (a 128-bit fingerprint of the set), registers and parity sketch of every row."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(lambda batches: _sketched(batches, words), "doc_id string, n long, set_a long, set_b long, registers binary, parity binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def _banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i in range(0, len(batch), 2000):
            part = batch.iloc[i : i + 2000]
            yield pd.DataFrame({"band": band_keys(_registers(part["registers"])).ravel(), "id": np.repeat(part["id"].to_numpy(), BANDS)})


def _likely(percent: int):
    """A column function: whether pairs (registers, parity sketches, sizes) may meet the threshold."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series, p_a: pd.Series, p_b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        out, x, y = np.zeros(len(a), bool), n_a.to_numpy(), n_b.to_numpy()
        at = np.flatnonzero(near_enough(p_a.tolist(), p_b.tolist(), x, y, percent)) if len(a) else np.empty(0, int)
        if len(at):
            out[at] = plausible(*_counts(_registers(a.iloc[at]), _registers(b.iloc[at])), x[at], y[at], percent / 100)
        return pd.Series(out)

    return run


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that arrive sorted by ``keys``; groups are bounded by their makers."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else batch.reset_index(drop=True)
        k = rows[keys].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        for a, b in zip(np.r_[0, cuts[:-1]] if len(cuts) else [], cuts, strict=True):
            yield rows.iloc[a:b]
        held = [rows.iloc[cuts[-1] :] if len(cuts) else rows]
    if held:
        yield pd.concat(held, ignore_index=True)


def _verified(batches: Iterator[pd.DataFrame], words: int, percent: int) -> Iterator[pd.DataFrame]:
    """Pairs whose full sets are alike enough; rows of one hub and share arrive together, the hub's texts (role 0) first."""
    now, own = None, []
    for batch in batches:
        out = []
        for hub, share, role, other, text in batch[["hub", "share", "role", "id", "text"]].itertuples(index=False):
            if now != (hub, share):
                now, own = (hub, share), []
            s = shingles(text, words)
            if role == 0:
                own.append(s)
                continue
            for h in own:
                if 100 * min(len(s), len(h)) < percent * max(len(s), len(h)):
                    continue
                both = len(np.intersect1d(s, h, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(h) - both):
                    out.append((other, hub))
                    break
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def verify(texts: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The stored pairs (a, hub) whose full sets meet the threshold, as (a, b); ``texts`` has id and text.

    Texts are joined to their roles by a shuffle at every size, since the roles grow with the input. A hub's members are dealt to shares
    of about SHARE, each with the hub's text.
    """
    shares = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    dealt = store(pairs.join(shares, "hub").select("hub", "a", "shares"), "dealt")
    roles = store(
        dealt.select("hub", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("role"), F.col("a").alias("id"))
        .union(dealt.select("hub", "shares").distinct().select("hub", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)), F.lit(0), "hub")),
        "roles",
    )
    rows = texts.join(roles.hint("merge"), "id").select("hub", "share", "role", "id", "text")
    sorted_rows = rows.repartition("hub", "share").sortWithinPartitions("hub", "share", "role")
    out = store(sorted_rows.mapInPandas(lambda batches: _verified(batches, words, percent), "a long, b long"), "links")
    discard(dealt, roles)
    return out


class _Held:
    """Members of a block by the width of their parity sketches, folded to other widths as they are asked for."""

    def __init__(self, rows: pd.DataFrame):
        self.ids, self.labels, self.sizes, self.masks = (rows[c].to_numpy() for c in ("id", "label", "n", "mask"))
        self.registers, sketch = _registers(rows["registers"]), rows["parity"].tolist()
        widths = np.array(list(map(len, sketch))) // 8
        self.at = {w: np.flatnonzero(widths == w) for w in np.unique(widths).tolist()}
        self.words = {(w, w): _words([sketch[i] for i in at]) for w, at in self.at.items()}

    def near(self, sketch: bytes, n: int, label: int, mask: int, percent: int) -> np.ndarray:
        """Places of the members of other components that share a band and whose parity sketches allow the threshold."""
        own, found, open_ = _words([sketch]), [], (self.labels != label) & (self.masks & mask != 0)
        for w, at in self.at.items():
            width = min(w, own.shape[1])
            if max(w, own.shape[1]) > 4 * width:  # sizes too unlike
                continue
            if (w, width) not in self.words:
                self.words[w, width] = _folded(self.words[w, w], width)
            rows = np.flatnonzero(open_[at])
            at, apart = at[rows], np.bitwise_count(self.words[w, width][rows] ^ _folded(own, width)).sum(1)
            found.append(at[apart <= most_apart(self.sizes[at], n, percent)])
        return np.concatenate(found) if found else np.empty(0, int)


def _rest(batches: Iterator[pd.DataFrame], percent: int, forest: bool) -> Iterator[pd.DataFrame]:
    """Likely pairs between a block's askers (role 0) and its members (role 1) of other components, as role _PAIR, greater and lesser id.

    With ``forest`` a pair counts only if no pairs before it in the block join its components: a block of n rows gives less than n.
    Every asker and member of a likely pair, counted or not, is then given too: its role, hub, other hub and id.
    """
    for rows in _groups(batches, ["hub", "other", "i", "j"]):
        asks, members = rows[rows["role"] == 0], rows[rows["role"] == 1]
        if asks.empty or members.empty:
            continue
        held, out, parent, met = _Held(members), [], {}, {}
        at_hub, at_other = int(rows["hub"].iloc[0]), int(rows["other"].iloc[0])

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while x in parent:
                x = parent[x]
            return x

        for own, label, n, mask, registers, sketch in asks[["id", "label", "n", "mask", "registers", "parity"]].itertuples(index=False):
            near = held.near(sketch, n, label, mask, percent)
            if not len(near):
                continue
            counts = _counts(np.frombuffer(registers, np.uint16)[None], held.registers[near])
            likely = plausible(*counts, np.full(len(near), n), held.sizes[near], percent / 100)
            near, equal = near[likely], counts[2][likely]
            if forest and len(near):
                met |= {(0, at_hub, at_other, int(own)): None} | {(1, at_hub, at_other, int(x)): None for x in held.ids[near]}
            for i in near[np.lexsort((held.ids[near], -equal))] if forest else near:
                if forest:
                    x, y = root(label), root(held.labels[i])
                    if x == y:
                        continue
                    parent[max(x, y)] = min(x, y)
                other = int(held.ids[i])
                out.append((_PAIR, max(own, other), min(own, other), 0))
        if out:
            yield pd.DataFrame([*out, *met], columns=["role", "a", "b", "c"]).astype({"role": "int32", "a": "int64", "b": "int64", "c": "int64"}).drop_duplicates()


def _cells(sized: DataFrame) -> DataFrame:
    """Askers and members of each block (hub, other, i, j)."""
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["id", "label", "mask"]
    return sized.where("asks").select("hub", "other", deal("across").alias("i"), span("down").alias("j"), F.lit(0).alias("role"), *own).union(
        sized.where("member").select("hub", "other", span("across").alias("i"), deal("down").alias("j"), F.lit(1).alias("role"), *own)
    )


def _apart(open_: DataFrame) -> DataFrame:
    """Open rows by (hub, other): all rows of a hub with itself, but of a crowded hub only those of several of its bands; and the rows
    of two crowded hubs with both. A pair with two bands in common thus meets by one hub of both bands, by one that is not crowded, or
    by two that are; it asks by the lesser one."""
    own = ["id", "label", "mask", "asks"]
    rows = open_.where("not crowded or bands > 1").select("hub", F.col("hub").alias("other"), *own)
    hubs = open_.where("crowded").groupBy("id", "label").agg(F.collect_list(F.struct("hub", "mask", "asks")).alias("hubs"))  # at most one a band
    pairs = hubs.where(F.size("hubs") > 1).select("id", "label", "hubs", F.explode("hubs").alias("h")).select("id", "label", "h", F.explode("hubs.hub").alias("other"))
    both = pairs.where("h.hub < other").select("h.hub", "other", "id", "label", "h.mask", "h.asks")
    return rows.union(both)


def _remaining(members: DataFrame, labels: DataFrame, reps: DataFrame, percent: int, seen: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Stored likely pairs (a, hub) between components that share a band, other than pairs with the band's hub, and the rows (role, hub,
    other, id) that have one; see ``_rest``. ``seen`` are those rows of the forest before: components only grow, so no others can have
    one now, and a hub of several components is as crowded as before.

    A hub's bands hold much the same rows, so a row stands once for all of them, with a mask of its bands: 64 bits, of which pairs that
    share a band share one.
    """
    if seen is not None:
        members = members.join(seen.select(F.explode(F.array("hub", "other")).alias("hub")).distinct(), "hub", "left_semi")
    bit = F.expr("shiftleft(1L, int(pmod(band, 64)))")
    named = members.join(labels.withColumnRenamed("node", "id"), "id", "left").groupBy("hub", "id")
    named = store(named.agg(F.bit_or(bit).alias("mask"), F.count(F.lit(1)).alias("bands"), F.min(F.coalesce("label", "id")).alias("label")), "named")
    mains = named.where("id = hub").select("hub", F.col("label").alias("main"))
    counts = named.groupBy("hub").agg(F.count(F.lit(1)).alias("rows"), F.min("label").alias("low"), F.max("label").alias("high")).where("rows > 2 and low < high")
    mixed = store(counts.join(mains, "hub").select("hub", "main", (F.col("rows") - 1 > SIDE).alias("crowded")), "mixed")
    open_ = store(named.join(mixed, "hub").where("id <> hub").select("hub", "id", "label", "mask", "bands", "crowded", (F.col("label") != F.col("main")).alias("asks")), "open")
    rows = _apart(open_).withColumn("member", F.lit(True))
    if seen is not None:
        keys = ["hub", "other", "id"]
        roles = seen.groupBy(keys).agg(F.bool_or(F.col("role") == 0).alias("asked"), F.bool_or(F.col("role") == 1).alias("met"))
        rows = rows.join(roles, keys).select(*keys, "label", "mask", (F.col("asks") & F.col("asked")).alias("asks"), F.col("met").alias("member"))
    rows = store(rows, "rows")
    blocks = lambda c: F.ceil(F.count_if(c) / SIDE).cast("int")
    asking = rows.groupBy("hub", "other").agg(blocks(F.col("asks")).alias("across"), blocks(F.col("member")).alias("down")).where("across > 0 and down > 0")
    sized = store(rows.join(asking, ["hub", "other"]), "sized")
    forest, keys = seen is None, ["hub", "other", "i", "j"]
    cells = _cells(sized).join(reps, "id").repartition(*keys).sortWithinPartitions(*keys)
    out = store(cells.mapInPandas(lambda batches: _rest(batches, percent, forest), "role int, a long, b long, c long").distinct(), "rest")
    discard(named, mixed, open_, rows, sized)
    pairs = out.where(F.col("role") == _PAIR).select("a", F.col("b").alias("hub"))
    return pairs, out.where(F.col("role") != _PAIR).select("role", F.col("a").alias("hub"), F.col("b").alias("other"), F.col("c").alias("id"))


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of every row of ``docs``.

    Null, empty and wordless texts have an empty set and are linked with nothing. Equal sets are one node, so copies of any number
    cost one sketch. Rows that share a doc_id are one document with several texts: a link of one is a link of all. Rows with a null
    doc_id are not linked; their component is null and they are kept. Empty table: no rows.
    """
    rows = store(sketch(docs, words), "sketches")
    linked = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    nodes = store(linked.groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("id"), F.min("registers").alias("registers"), F.min("parity").alias("parity")), "nodes")
    bands = nodes.select("id", "registers").mapInPandas(_banded, "band long, id long")
    hubs = store(bands.groupBy("band").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("band", "hub"), "hubs")
    members = store(bands.join(hubs, "band"), "members")
    reps = store(nodes.join(members.select("id").distinct(), "id", "left_semi").select("id", "n", "registers", "parity"), "reps")
    first = members.where("id <> hub").select(F.col("id").alias("a"), "hub").distinct()
    sides = first.join(reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"), F.col("parity").alias("p_a")), "a")
    sides = sides.join(reps.select(F.col("id").alias("hub"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"), F.col("parity").alias("p_b")), "hub")
    pairs = store(sides.where(_likely(percent)("r_a", "r_b", "p_a", "p_b", "n_a", "n_b")).select("a", "hub").distinct(), "pairs")
    # all pairs lie between representatives that share a band: the other texts are shuffled once and then left behind
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = store(texts.join(reps.select("id").hint("merge"), "id", "left_semi"), "texts")
    links = verify(texts, pairs, words, percent)
    labels, tried = components(links), pairs
    seen = None
    for _ in ("forest", "all"):
        rest, seen = _remaining(members, labels, reps, percent, seen)
        new = store(rest.join(tried, ["a", "hub"], "left_anti"), "untried")
        if new.isEmpty():
            if rest.isEmpty():
                break  # nothing likely lies between components
            continue
        more = verify(texts, new, words, percent)
        tried = tried.union(new)
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links)
    named = nodes.select("set_a", "set_b", "id").join(labels.withColumnRenamed("node", "id"), "id", "left")
    named = store(named.groupBy("set_a", "set_b").agg(F.min(F.coalesce("label", "id")).alias("component_id")), "components")
    discard(hubs, members, reps, pairs, nodes, texts)
    sized = rows.select("doc_id", F.col("n").alias("n_shingles"), "set_a", "set_b")
    out = sized.where("doc_id is not null and n_shingles > 0").join(named, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", "component_id")
    alone = sized.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = out.union(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are the least of their group, with their columns."""
    gone = store(groups(docs, words, percent).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
