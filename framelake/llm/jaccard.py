"""N-gram Jaccard join by a token-group matrix.

A document's set holds its distinct shingles of n words. Two documents link when den * |intersection| >= num * |union|.
Documents of one set are a single node from the start.

1. Two linked sets differ in at most k tokens, k known from their sizes; so of more than k parts of all tokens (dealt out
   by hash) some must be the same in both. Each node names its parts, and nodes that share a name are of one family.
2. A family's nodes, in the order of their least token (similar sets mostly share it) and size, are partitioned into
   groups of ROW. A group keeps the union of its members' tokens: a row of the matrix of tokens by groups. The overlap of
   a query with a union bounds its similarity with each member.
3. Only groups whose bound reaches the threshold are opened, and their members compared exactly.

A family above CELL nodes is dealt into cells by that of each node's names which most nodes have, so each text moves once.
Some nodes of all that is known to belong together then meet in one cell, which joins nearly all of a family of true
copies. If a family still holds several classes, the nodes outside its largest one are queries, and meet all nodes of the
family, block by block: no task grows with a family, and texts move again only for such families. Every two nodes of a
family so are known to belong together, or are compared.

A family that still holds several classes and is above WIDE * CELL nodes (texts of one template, say, which share parts
but don't link) is first taken apart by its own rarest tokens: in the order of how many of the family's sets hold a token,
two linked sets share one of their first size - least overlap + 1. Nodes that share none of these belong to no common
smaller family and never meet; its tokens move once, whatever its size. Smaller families are then treated as above.

Links are kept as a spanning forest of each cell; components come from these. All pairs of a group are never emitted.
A node is a hash of 126 bits of its set.

Tokens that a large share of all sets has (COMMON: a line or passage that very many documents repeat) name no parts:
leaving tokens out of both sets never makes them differ in more, so what is said above still holds.

Parts that hold few tokens (under `least`) would be shared by chance. There are `spare` more parts than k + 1 needs, so
they can be left out by every node that has at most `spare` of them; a node that has more also names its parts under
another dealing, and so on until it has not. As equal parts are small in both nodes or in neither, the dealing at which
the first of two nodes stops has a part to share that both name.

Defined cases: a null text or one without words has no set, links with nothing and is its own component; fewer words
than n make one shingle of all of them; rows that repeat a key are nodes' rows of their own (a node's text is found by key
and a hash of the text, and its set is checked); a null key is never the
name of a component unless all its rows' keys are null; texts are taken whole; an empty table gives an empty result;
other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .components import components
from .scratch import counted, folder, looked_up, materialise, measured

#: Members, and queries, of a cell at most, or about.
CELL = 1024
#: Cells of a family beyond which its own rare tokens take it apart.
WIDE = 8
#: Members of a group.
ROW = 16
#: Dealings that a node may go through.
DEALINGS = 8
#: Tokens that a dense part of the matrix has.
SLAB = 4096
#: Tokens in this share of all sets name no parts. There are at most 1 / COMMON times as many as tokens in a set.
COMMON = 0.0005
#: Sets of a block with a token for it to be reported.
LEAST = 2
NODE = "decimal(38,0)"


@lru_cache(maxsize=None)
def bands(num: int, den: int) -> np.ndarray:
    """The largest size of each band: a set links only with sets of its own band and the next or last."""
    out, lo = [], 1
    while lo < 1 << 40:
        out.append(lo * den // num)
        lo = out[-1] + 1
    return np.array(out)


@lru_cache(maxsize=None)
def dealing(band: int, num: int, den: int) -> tuple[int, int, int]:
    """Of pairs whose smaller set is of this band: parts (0: linked sets are equal), spare, least."""
    high = int(bands(num, den)[band])
    low = int(bands(num, den)[band - 1]) + 1 if band else 1
    k = (high + high * den // num) * (den - num) // (den + num)
    if k == 0:
        return 0, 0, 0

    def small(parts: int, least: int) -> float:
        mean = low / parts
        return parts * sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(least))

    for least in (3, 2, 1):
        for spare in range(1, 4 + k // 6):
            m = small(k + 1 + spare, least)
            if m + 2 * math.sqrt(m) <= spare:
                return k + 1 + spare, spare, least
    return k + 2, 1, 1


def token_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens of each document one after the other, and how many each has."""
    starts, ends, packed, first = B.words(B.LOWER[data], offsets)
    code, distinct = B.codes(packed, ends - starts)
    h = B.hashes(distinct)[code]
    g = B.grams(h, n)
    out, count = [], np.zeros(len(offsets) - 1, np.int64)
    for i, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if z - a >= n:
            t = np.unique(g[a : z - n + 1])
        elif z > a:
            t = B.grams(h[a:z], z - a) ^ np.uint64(z - a)
        else:
            continue
        out.append(t)
        count[i] = len(t)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), count


def node_hashes(tokens: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of 126 bits of each set, which is its node: two numbers, the low one first."""
    at = np.concatenate([[0], np.cumsum(count)])
    raw = memoryview(np.ascontiguousarray(tokens)).cast("B")
    whole = [(xxhash.xxh3_128_intdigest(raw[8 * a : 8 * z]) >> 2).to_bytes(16, "little") for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(whole), np.uint64).reshape(-1, 2)


def node_column(node: np.ndarray, known: np.ndarray) -> pa.Array:
    """Nodes as decimals, which are of one length in Spark's rows; null where not known."""
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(node), [pa.array(known, pa.bool_()).buffers()[1], pa.py_buffer(np.ascontiguousarray(node))])


def column_nodes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.uint64, 2 * len(column), 16 * column.offset).reshape(-1, 2) if len(column) else np.zeros((0, 2), np.uint64)


def first_of_each(node: np.ndarray) -> np.ndarray:
    """Where each different node is first."""
    seen: dict[bytes, int] = {}
    for i, x in enumerate(map(bytes, np.ascontiguousarray(node).view("V16").ravel())):
        seen.setdefault(x, i)
    return np.array(list(seen.values()), np.int64)


def names(tokens: np.ndarray, count: np.ndarray, num: int, den: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The parts that nodes name: which node, and the part's name. tokens: sorted in each node; common: those that name none, sorted."""
    band = np.searchsorted(bands(num, den), count)
    left = count
    if common is not None and len(common) and len(tokens):
        rare = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] != tokens
        left = np.bincount(np.repeat(np.arange(len(count)), count)[rare], minlength=len(count))
        tokens = tokens[rare]
    at = np.concatenate([[0], np.cumsum(left)])
    nodes, out = [], []
    for step in (0, 1):  # as the smaller of a pair, and as the larger of one whose smaller is a band below
        todo = np.flatnonzero((count > 0) & (band >= step))
        setting = {b: dealing(int(b) - step, num, den) for b in np.unique(band[todo])}
        parts, spare, least = (np.array([setting[b][k] for b in band[todo]], np.int64) for k in range(3))
        for turn in range(DEALINGS):
            go = parts > 0
            todo, parts, spare, least = todo[go], parts[go], spare[go], least[go]
            if not len(todo):
                break
            size = left[todo]
            own = np.repeat(np.arange(len(todo)), size)
            t = tokens[B.ragged(at[todo], size)]
            salt = B.mix(np.array([turn + 1], np.uint64))[0]
            dealt = B.mix(t ^ salt)
            # the dealing is by the token's own hash, whose place among `parts` even slices is its part
            part = ((dealt >> np.uint64(32)) * parts[own].astype(np.uint64)) >> np.uint64(32)
            base = np.concatenate([[0], np.cumsum(parts)])
            slot = base[own] + part.astype(np.int64)
            order = np.argsort(slot, kind="stable")
            slot, dealt = slot[order], dealt[order]
            head = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])[: len(slot)])
            held = np.diff(np.append(head, len(slot)))
            what = np.add.reduceat(B.mix(dealt + np.uint64(1)), head) if len(head) else dealt
            slot = slot[head]
            who = np.searchsorted(base, slot, "right") - 1
            big = held >= least[who]
            few = parts - np.bincount(who[big], minlength=len(todo)) > spare  # too many small parts
            if turn == DEALINGS - 1:
                big = np.ones(len(held), bool)
                empty = parts - np.bincount(who, minlength=len(todo)) > 0
                for i in np.flatnonzero(few & empty):
                    all_ = np.setdiff1d(np.arange(base[i], base[i + 1]), slot[who == i])
                    nodes.append(np.full(len(all_), todo[i]))
                    out.append(_name(np.zeros(len(all_), np.uint64), all_ - base[i], band[todo[i]] - step, turn, np.zeros(len(all_), np.int64)))
            who, what, slot, held = who[big], what[big], slot[big], held[big]
            nodes.append(todo[who])
            out.append(_name(what, slot - base[who], band[todo[who]] - step, turn, held))
            todo, parts, spare, least = todo[few], parts[few], spare[few], least[few]
    return (np.concatenate(nodes), np.concatenate(out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _name(what: np.ndarray, part: np.ndarray, band: np.ndarray | int, turn: int, held: np.ndarray) -> np.ndarray:
    place = part.astype(np.uint64) + (np.uint64(turn) << np.uint64(58)) + (np.asarray(band).astype(np.uint64) << np.uint64(48))
    return B.mix(B.mix(what + held.astype(np.uint64)) ^ B.mix(place + np.uint64(0x51ED2701)))


def common_tokens(df: DataFrame, n: int, text: str) -> np.ndarray:
    """Tokens in a share COMMON of all sets, found over all texts: each block reports those that LEAST of its different sets have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.gathered(batches, "text", B.BLOCK_BYTES):
            tokens, size = token_sets(*B.buffers(block.column("text")), n)
            at = np.concatenate([[0], np.cumsum(size)])
            whole = np.concatenate([[np.uint64(0)], np.cumsum(tokens)])
            _, once = np.unique(whole[at[1:]] - whole[at[:-1]], return_index=True)  # near enough for counts: equal sums, equal sets
            token, times = np.unique(tokens[B.ragged(at[once], size[once])], return_counts=True)
            keep = times >= LEAST
            token, times = np.append(token[keep].view(np.int64), 0), np.append(times[keep], len(once))  # 0: all sets
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(times)], ["token", "n"])

    sums = df.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    sums, seen = measured(sums.where("token = 0 or n >= 16"), "common", total=F.sum(F.when(F.col("token") == 0, F.col("n"))))
    total = seen["total"] or 0
    found = sums.where((F.col("token") != 0) & (F.col("n") >= COMMON * total)).collect()
    return np.sort(np.array([r.token for r in found], np.int64).view(np.uint64))


def nodes_of(df: DataFrame, n: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """key, own (the text's hash), node (null without words), short (half of its bits), size, parts (null where the same block has named them)."""
    common = common_tokens(df, n, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.gathered(batches, "text", B.BLOCK_BYTES // 2):
            tokens, count = token_sets(*B.buffers(block.column("text")), n)
            at = np.concatenate([[0], np.cumsum(count)])
            node = node_hashes(tokens, count)
            once = first_of_each(node)
            once = once[count[once] > 0]
            which, name = names(tokens[B.ragged(at[once], count[once])], count[once], num, den, common)
            order = np.argsort(which, kind="stable")
            ends = np.searchsorted(which[order], np.arange(len(once) + 1))
            full = np.zeros(len(count), np.int64)
            full[once] = np.diff(ends)
            # lists in the order of rows: nodes in `once` are not
            rank = np.full(len(count), -1)
            rank[once] = np.arange(len(once))
            rows = np.flatnonzero(full)
            flat = name[order][B.ragged(ends[:-1][rank[rows]], full[rows])]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full)]).astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([block.column("key"), block.column("own"), node_column(node, count > 0), pa.array(node[:, 0].view(np.int64)), pa.array(count), lists], ["key", "own", "node", "short", "size", "parts"])

    rows = df.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("own"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, own long, node {NODE}, short long, size long, parts array<long>")


def linked(sets: list[np.ndarray], member: np.ndarray, query: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between queries and members (indices of sets), by the matrix."""
    size = np.array([len(s) for s in sets])
    m = np.flatnonzero(member)
    least = np.array([s[0] if len(s) else np.uint64(0) for s in sets], np.uint64)
    m = m[np.lexsort((size[m], least[m]))]
    q = np.flatnonzero(query)
    flat = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), size)
    token, which, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[which] > 1  # a token of one set alone is in no intersection, and only raises bounds
    _, which = np.unique(which[shared], return_inverse=True)
    own = own[shared]
    order = np.argsort(which, kind="stable")
    which, own = which[order], own[order]
    tokens = int(which[-1]) + 1 if len(which) else 0
    rows = [m[k : k + ROW] for k in range(0, len(m), ROW)]
    in_row = np.full(len(sets), -1)
    for k, r in enumerate(rows):
        in_row[r] = k
    place_q = np.full(len(sets), -1)
    place_q[q] = np.arange(len(q))
    place_m = np.full(len(sets), -1)
    place_m[m] = np.arange(len(m))

    def slab(a: int, place: np.ndarray, width: int) -> np.ndarray:
        i, j = np.searchsorted(which, (a, a + SLAB))
        ok = place[own[i:j]] >= 0
        out = np.zeros((min(SLAB, tokens - a), width), np.float32)
        out[which[i:j][ok] - a, place[own[i:j][ok]]] = 1
        return out

    bound = np.zeros((len(q), len(rows)), np.float32)
    for a in range(0, tokens, SLAB):
        bound += slab(a, place_q, len(q)).T @ slab(a, in_row, len(rows))
    top, bottom = np.array([size[r].max() for r in rows]), np.array([size[r].min() for r in rows])
    # of any member S: |Q and S| <= the overlap with the row's union, and |Q or S| >= the larger of the two
    largest = np.minimum(bound, top[None, :])
    opened = (den * largest >= num * np.maximum(size[q][:, None], bottom[None, :])) & (den * size[q][:, None] >= num * bottom[None, :])
    some_q, some_r = np.flatnonzero(opened.any(1)), np.flatnonzero(opened.any(0))
    if not len(some_q):
        return []
    picked = np.concatenate([rows[r] for r in some_r])
    sub_q, sub_m = np.full(len(sets), -1), np.full(len(sets), -1)
    sub_q[q[some_q]] = np.arange(len(some_q))
    sub_m[picked] = np.arange(len(picked))
    common = np.zeros((len(some_q), len(picked)), np.float32)
    for a in range(0, tokens, SLAB):
        common += slab(a, sub_q, len(some_q)).T @ slab(a, sub_m, len(picked))
    sizes = size[q[some_q]][:, None] + size[picked][None, :]
    link = den * common >= num * (sizes - common)
    link &= np.repeat(opened[np.ix_(some_q, some_r)], [len(rows[r]) for r in some_r], 1)
    label, out = np.arange(len(sets)), []
    for i in np.flatnonzero(link.any(1)):
        x, met = int(q[some_q[i]]), picked[link[i]]
        others, at = np.unique(label[met], return_index=True)
        new = others != label[x]
        if new.any():
            out += [(x, int(y)) for y in met[at[new]]]
            label[np.isin(label, np.append(others, label[x]))] = min(int(label[x]), int(others[0]))
    return out


def _cell(n: int, num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        one = {c: table[c].combine_chunks() if table[c].num_chunks != 1 else table[c].chunk(0) for c in ("text", "node", "member", "query")}
        tokens, count = token_sets(*B.buffers(one["text"]), n)
        node = column_nodes(one["node"])
        own = np.flatnonzero((node_hashes(tokens, count) == node).all(1))  # a text of the node, and of equal ones the first
        own = own[first_of_each(node[own])]
        sets = np.split(tokens, np.cumsum(count)[:-1])
        member, query = (one[c].to_numpy(zero_copy_only=False)[own] for c in ("member", "query"))
        root = np.arange(len(own))
        for a, b in linked([sets[i] for i in own], member, query, num, den) if len(own) else []:
            x, y = sorted((root[a], root[b]))
            root[root == y] = x
        star = np.flatnonzero(root != np.arange(len(own)))
        return pa.table({"a": one["node"].take(pa.array(own[star])), "b": one["node"].take(pa.array(own[root[star]]))})

    return run


def compared(filled: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Components inside cells as stars: a, b (the node that stands for a's component). filled: node, text, g, m, i, j (which cell), member, query."""
    return filled.groupBy("g", "m", "i", "j").applyInArrow(_cell(n, num, den), f"a {NODE}, b {NODE}")


def labels_of(df: DataFrame, nodes: DataFrame, n: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """node, label: the component of each node that has links, written. nodes: from nodes_of, written."""
    # families only say what may link, so half of a node's bits will do for them: a clash puts two families together
    sets, w = nodes.where("node is not null"), Window.partitionBy("part")
    named = sets.select("short", F.explode("parts").alias("part")).withColumns({"b": F.min("short").over(w), "z": F.max("short").over(w), "n": F.count(F.lit(1)).over(w)})
    shared = materialise(named.where("b <> z").select("part", "short", "b", "n"), "shared-names")  # a small share: most names are one node's
    met = shared.select(F.col("short").alias("a"), "b").where("a > b").distinct()
    family = components(met).select(F.col("node").alias("short"), F.col("label").alias("g"))
    first = sets.groupBy("node", "short").agg(F.min_by(F.struct("key", "own"), F.struct(F.col("key").isNull(), "key", "own")).alias("row"))
    first, nodes_left = counted(first.join(family, "short").select("node", "short", "g", "row.key", F.col("row.own").alias("text_hash")), "first-rows")
    texts = df.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text"))
    # the one time that all texts move. By a merge at every size: where nodes are few enough to be sent to all tasks, texts would not move, and figures not compare
    family = first.hint("merge").join(texts, first["key"].eqNullSafe(texts["key"]) & (first["text_hash"] == texts["text_hash"]))
    family, texts_left = counted(family.select("node", "short", "g", "text"), "families")
    if texts_left > nodes_left:  # rows that repeat key and text: of a node's texts one goes on (two, should two texts of a key have one hash)
        family = materialise(family.distinct(), "families")  # map-side first, so copies of a row aren't sent
    large, larges = counted(family.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).select("g"), "large-families")
    yes = F.lit(True)
    # a family of one cell's size is a cell; of a larger one each node goes where that of its names says which most nodes have
    small = family.join(large, "g", "left_anti").select("node", "text", "g", F.lit(0).cast("long").alias("m"), F.lit(0).alias("i"), F.lit(0).alias("j"), yes.alias("member"), yes.alias("query"))
    if not larges:
        return _labels(materialise(compared(small, n, num, den), "stars"))
    most = shared.groupBy("short").agg(F.max(F.struct("n", "part"))["part"].alias("name"))
    crowd = materialise(family.join(large, "g", "left_semi").select("node", "short", "g").distinct().join(most, "short"), "crowds")
    sizes = materialise(crowd.groupBy("name").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cut")).where("cut > 1"), "crowded-names")
    deal = lambda c, salt: F.pmod(F.xxhash64("node", F.lit(salt)), c).cast("int")
    blocks = crowd.join(sizes, "name", "left").select("node", "g", F.col("name").alias("m"), deal(F.coalesce("cut", F.lit(1)), 0).alias("i"), F.lit(0).alias("j"), yes.alias("member"), yes.alias("query"))
    fill = lambda cells: family.select("node", "text").join(cells, "node")
    look = lambda filled: materialise(compared(filled, n, num, den), "stars")
    known = look(small.unionByName(fill(blocks)))
    own = known.select(F.col("a").alias("node"), F.col("b").alias("label"))  # each node was in one cell, so these are final there
    label = materialise(crowd.join(own, "node", "left").select("node", "g", F.coalesce("label", "node").alias("label")), "crowd-labels")
    of = label.select("node", "label")

    def joined(stars: DataFrame) -> DataFrame:
        """Labels that stars put together."""
        both = stars.join(of.toDF("a", "u"), "a").join(of.toDF("b", "v"), "b").where("u <> v")
        return materialise(both.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "label-pairs")

    def now(pairs: DataFrame) -> DataFrame:
        """The crowds with the labels that pairs leave."""
        end = materialise(components(pairs).select(F.col("node").alias("label"), F.col("label").alias("end")), "ends")
        return looked_up(label, end, "label").withColumn("label", F.coalesce("end", "label")).drop("end")

    # what is known so far is joined by some of each: as many as fit in one cell of a family
    chosen = label.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("deal", F.pmod(F.xxhash64("label"), F.lit(64)))
    chosen = _top(chosen, ["g"], [F.desc("n"), F.col("label")], F.lit(CELL // 4))
    chosen = materialise(chosen.select("g", "label", F.floor(F.lit(CELL) / F.count(F.lit(1)).over(Window.partitionBy("g"))).alias("each")), "some")
    some = _top(label.withColumn("deal", deal(F.lit(64), 2)).join(chosen, ["g", "label"]), ["g", "label"], [F.xxhash64("node", F.lit(1)), F.col("node")], F.col("each"))
    pairs = joined(look(fill(some.select("node", "g", F.lit(1).cast("long").alias("m"), F.lit(0).alias("i"), F.lit(0).alias("j"), yes.alias("member"), yes.alias("query")))))
    seen = materialise(now(pairs), "crowd-labels")
    # families that are one class by now are done with; in others, what isn't of the largest class is compared with all
    tops, open_ = _open(seen)
    wide, wides = counted(tops.where(F.col("n") > WIDE * CELL).select("g"), "wide-families")
    if wides:
        apart = seen.join(rarely_met(family.select("node", "text").join(seen.join(wide, "g", "left_semi").select("node", "g"), "node"), n, num, den), "node").select("node", F.col("sub").alias("g"), "label")
        seen = materialise(seen.join(wide, "g", "left_anti").unionByName(apart.select(*seen.columns)), "crowd-labels")
        tops, open_ = _open(seen)
    if not open_:
        return _labels(known, components(pairs))
    live = materialise(seen.join(tops, "g").select("node", "g", (F.col("label") != F.col("top")).alias("asks")), "live")
    need = live.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("n"), F.greatest(F.lit(1), F.ceil(F.count_if("asks") / CELL)).cast("int").alias("q"))
    need = materialise(need, "need")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = live.join(need, "g").withColumn("own", deal(F.col("n"), 0)).withColumn("turn", deal(F.col("q"), 3))
    members = dealt.withColumn("j", every("q")).select("node", "g", F.col("own").alias("i"), "j", yes.alias("member"), (F.col("asks") & (F.col("j") == F.col("turn"))).alias("query"))
    asking = dealt.where("asks").withColumn("i", every("n")).where(F.col("i") != F.col("own")).select("node", "g", "i", F.col("turn").alias("j"), F.lit(False).alias("member"), yes.alias("query"))
    last = members.unionByName(asking).withColumn("m", F.lit(2).cast("long"))
    return _labels(known, components(pairs.unionByName(joined(look(fill(last))))))


def _open(seen: DataFrame) -> tuple[DataFrame, int]:
    """g, n (nodes), top (the largest class) of families that hold several classes, written, and how many there are."""
    sizes = seen.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"))
    return counted(sizes.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.max(F.struct("n", "label"))["label"].alias("top")).where("k > 1").drop("k"), "open-families")


def rarely_met(texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """node, sub: smaller families of nodes that may link, by the rarest tokens of their family; nodes that can't link with any are left out. texts: node, text, g."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.gathered(batches, "text", B.BLOCK_BYTES // 2):
            token, count = token_sets(*B.buffers(block.column("text")), n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(token.view(np.int64)))
            yield pa.RecordBatch.from_arrays([block.column("node"), block.column("g"), lists], ["node", "g", "tokens"])

    sets = materialise(texts.select("node", "text", "g").mapInArrow(tokens, f"node {NODE}, g long, tokens array<long>"), "family-tokens")
    flat = sets.select("node", "g", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    met = materialise(flat.groupBy("g", "token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "met-tokens")
    # tokens of one set come first in the order, and are met by nobody
    size = F.first("size")
    own = flat.join(met, ["g", "token"]).groupBy("node", "g").agg(size.alias("size"), F.sort_array(F.collect_list(F.struct("n", "token"))).alias("met"))  # tokens of one set
    least = F.ceil(F.col("size") * num / den).cast("int")
    first = F.greatest(F.lit(0), F.col("size") - least + 1 - (F.col("size") - F.size("met")))
    shared = own.select("node", "g", F.explode(F.slice("met", 1, first)).alias("m")).select("node", "g", F.col("m.token").alias("token"))
    shared = materialise(shared, "rare-tokens")
    heads = shared.groupBy("g", "token").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = shared.join(heads, ["g", "token"]).where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    return components(edges).select("node", F.xxhash64("label").alias("sub"))  # a clash puts two together


def _labels(stars: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """node, label of stars (a, b), written; ends: node, label of stars' centres, or of nodes without a star, that belong together."""
    own = stars.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    if ends is None:
        return materialise(own, "labels")
    ends = materialise(ends.select(F.col("node").alias("label"), F.col("label").alias("end")), "ends")
    alone = ends.join(stars.select(F.col("b").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), "label")
    own, n = counted(own.unionByName(alone), "centres")
    return materialise(looked_up(own, ends, "label", n).select("node", F.coalesce("end", "label").alias("label")), "labels")


def _top(df: DataFrame, keys: list[str], order: list[Column], most: Column) -> DataFrame:
    """The first `most` rows of each key, found in pieces (by `deal`) first, so that no task ranks a whole key."""
    for by in ([*keys, "deal"], keys):
        df = df.withColumn("r__", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r__") <= most).drop("r__")
    return df


def classes(df: DataFrame, n: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """For each row, written: key, own (the text's hash), size, least (the smallest key of its component), stay (the component's first row), where stay is null if the row is alone."""
    with folder(df.sparkSession, "jaccard"):
        nodes, rows = counted(nodes_of(df, n, num, den, key, text), "nodes")
        labels = labels_of(df, nodes, n, num, den, key, text)
        row = F.struct(F.col("key").isNull().alias("none"), "key", "own")
        own = nodes.where("node is not null").groupBy("node").agg(F.min("key").alias("least"), F.min(row).alias("stay"), F.count(F.lit(1)).alias("rows"))
        own = materialise(own.join(labels, "node", "left").where("rows > 1 or label is not null").drop("rows"), "nodes-of-several")
        whole = materialise(own.where("label is not null").groupBy("label").agg(F.min("least").alias("least"), F.min("stay").alias("stay")), "components")
        few, n_few = counted(own.where("label is not null").select("node", "label"), "linked")
        far = looked_up(few, whole, "label", n_few).select("node", "least", "stay")
        known = materialise(own.where("label is null").select("node", "least", "stay").unionByName(far), "components-of-nodes")
        return materialise(looked_up(nodes.select("key", "own", "node", "size"), known, "node", rows).drop("node"), "classes", keep=True)


def join(df: DataFrame, n: int = 5, num: int = 8, den: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, n_shingles, component_id (the smallest key that it reaches by links)."""
    found = classes(df, n, num, den, key, text)
    return found.select(F.col("key").alias(key), F.col("size").alias("n_shingles"), F.when(F.col("stay").isNull(), F.col("key")).otherwise(F.col("least")).alias("component_id"))


def survivors(df: DataFrame, n: int = 5, num: int = 8, den: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df's rows without those of a component but the first (the least key, a null last; then the least hash of the text). Of rows that repeat key and text one stays, any; rows without words all stay."""
    found = classes(df, n, num, den, key, text).where("stay is not null").select(F.col("key").alias("__key"), F.col("own").alias("__own"), ((F.col("stay.own") == F.col("own")) & F.col("stay.key").eqNullSafe(F.col("key"))).alias("first"))
    gone = found.where("not first").select("__key", "__own").distinct()
    same = df[key].eqNullSafe(gone["__key"]) & (F.xxhash64(df[text]) == gone["__own"])
    left = df.join(gone, same, "left_anti")
    twice, twices = counted(found.where("first").groupBy("__key", "__own").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated")
    if not twices:
        return left
    same = left[key].eqNullSafe(twice["__key"]) & (F.xxhash64(left[text]) == twice["__own"])
    return left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates([key, text]))
