"""Approximate nearest neighbours by NN-descent and greedy graph search.

Distinct vectors are the nodes of a graph of each node's best neighbours. It starts from
exact neighbours within two random deals into blocks. A round joins neighbours of
neighbours: every node lists a sample of its neighbours and of the nodes that name it, pairs
with a new one are compared, and what beats a node's worst neighbour replaces it, until
few change. The pairs of a node are never rows, and neither are the vectors that its lists need:
nodes are dealt into home blocks of bounded size, a block asks every other for the vectors that
its lists name, each once, and gets them as one packed row in 16 bits an entry; its best finds go
out as one packed row for every block that it has finds for.

A search starts from the query's own node, which is in the graph like any other, keeps a
beam of the best nodes met and follows the links of the best not yet followed, until all
of the beam are. The links, with their vectors in 16 bits, are written once in files by home block and
stay there: a query's vector goes to the blocks of the nodes that it follows, and what comes back are
ids and values that its beam has room for. The best of the beam are scored again in double precision on the original vectors.

For vectors of unequal lengths the graph is built on the vectors with one more entry that
makes all lengths equal, so that near there means a large inner product; the search uses inner products alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewmill.functions.vectors import doubles, dot
from reviewmill.llm.common import table
from reviewmill.session import materialize, release, shared_folder

DEGREE = 40  # neighbours of a node
SAMPLE = 20  # of them, and of nodes that name it, listed in a round, new and old each
START = 2_048  # nodes compared with each other at the start, twice
BLOCK = 1_024  # nodes of a home block, whose lists are joined in one group
PER_TASK = 4  # home blocks whose links are read by one task of a search round
SETTLED = 0.03  # the graph is done if fewer of its links are new
ASKING = 128  # queries that are searched for in one group
BEAM = 256  # nodes that a query keeps
FOLLOWED = 40  # of them followed in one round
RESCORED = 64  # of them scored again in double precision
ANSWERED = 32_768  # requests to a block that are answered in one group

STATE = "home int, node long, vec binary, ids binary, vals binary, new binary, worst float, n_new int"
FOUND = "home int, nodes binary, counts binary, ids binary, vals binary"
NAMED = "home int, v binary, member binary, mark binary"
LISTS = "home int, block int, v binary, member binary, mark binary"
VECTORS = "block int, names binary, scales binary, lasts binary, codes binary, worst binary"
LINKS = "home int, node long, links binary, scales binary, codes binary"
ASKED = "home int, part int, queries binary, blocks binary, vecs binary, worst binary, which binary, nodes binary"
SEARCH = "query long, vec binary, ids binary, vals binary, followed binary, wanted binary, n_open int"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _joined(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins and ends."""
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return begin, np.r_[begin[1:], len(key)].astype(int)[: len(begin)]


def _packed(node: np.ndarray, other: np.ndarray, val: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` best distinct others of every node: (nodes, where each begins, others, values)."""
    order = np.lexsort((other, node))
    node, other, val = node[order], other[order], val[order]
    once = np.r_[True, (node[1:] != node[:-1]) | (other[1:] != other[:-1])][: len(node)]
    node, other, val = node[once], other[once], val[once]
    order = np.lexsort((other, -val, node))
    node, other, val = node[order], other[order], val[order]
    begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]][: len(node)])
    place = np.arange(len(node)) - np.repeat(begin, np.diff(np.r_[begin, len(node)]))
    kept = place < most
    node, other, val = node[kept], other[kept], val[kept]
    begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]][: len(node)])
    return node[begin], begin, other, val


def _homes(nodes: np.ndarray, blocks: int) -> np.ndarray:
    """The block a node's state and lists are in."""
    mixed = nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(blocks)).astype(np.int32)


def _rows(home: np.ndarray, nodes: np.ndarray, counts: np.ndarray, other: np.ndarray, val: np.ndarray) -> pd.DataFrame:
    """One row for each home block: its nodes, how many finds each has, and the finds."""
    counts = counts.astype("<i4")
    order = np.argsort(home, kind="stable")
    far = np.argsort(np.repeat(home, counts), kind="stable")
    nodes, counts, other, val, home = nodes[order], counts[order], other[far], val[far], home[order]
    upto = np.r_[0, np.cumsum(counts)]
    cells = [(home[a], nodes[a:b].tobytes(), counts[a:b].tobytes(), other[upto[a] : upto[b]].tobytes(), val[upto[a] : upto[b]].tobytes()) for a, b in zip(*_runs(home))]
    return pd.DataFrame(cells, columns=_names(FOUND))


def _block(column: str, blocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(blocks)).cast("int")


def _within(most: int, blocks: int):
    """Rows of one block to the ``most`` nearest within it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        node = rows["node"].to_numpy()
        vecs = _joined(rows["vec"], "<f4").reshape(len(node), -1)
        if len(node) < 2:
            return pd.DataFrame(columns=_names(FOUND))
        score = vecs @ vecs.T
        np.fill_diagonal(score, -np.inf)
        k = min(most, len(node) - 1)
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        return _rows(_homes(node, blocks), node, np.full(len(node), k), node[near].ravel(), np.take_along_axis(score, near, 1).ravel())

    return run


def _listed(ids: bytes, new: bytes, node: int, turn: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the neighbours that a node lists in a round: (new ones, old ones). The same wherever it is asked."""
    n = len(ids) // 8
    mixed = np.frombuffer(ids, "<i8").astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((node * 2654435761 + turn * 40503) % (1 << 63))
    mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed * np.uint64(0xBF58476D1CE4E5B9), kind="stable")
    fresh = np.frombuffer(new, np.uint8)[order] > 0 if n else np.zeros(0, bool)
    return order[fresh][:sample], order[~fresh][:sample]


def _merge(turn: int, degree: int, sample: int):
    """State rows and finds of a home block to the next state; what was listed in this round isn't new any more."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["vec"].notna()]
        finds = rows[rows["vec"].isna()]
        node, other, val, fresh = [], [], [], []
        for n, ids, vals, new in zip(own["node"], own["ids"], own["vals"], own["new"]):
            still = np.frombuffer(new, np.uint8).copy()
            if turn >= 0:
                still[_listed(ids, new, n, turn, sample)[0]] = 0
            node.append(np.full(len(still), n))
            other.append(np.frombuffer(ids, "<i8"))
            val.append(np.frombuffer(vals, "<f4"))
            fresh.append(still)
        for nodes, counts, ids, vals in zip(finds["nodes"], finds["counts"], finds["ids"], finds["vals"]):
            node.append(np.repeat(np.frombuffer(nodes, "<i8"), np.frombuffer(counts, "<i4")))
            other.append(np.frombuffer(ids, "<i8"))
            val.append(np.frombuffer(vals, "<f4"))
            fresh.append(np.ones(len(ids) // 8, np.uint8))
        node, other, val, fresh = (np.concatenate([*x, np.zeros(0, t)]).astype(t) for x, t in ((node, "<i8"), (other, "<i8"), (val, "<f4"), (fresh, np.uint8)))
        nodes, begin, best, score = _packed(node, other, val, degree)
        # A link is new only if no earlier row had it.
        old = set(zip(node[fresh == 0].tolist(), other[fresh == 0].tolist()))
        ends = np.r_[begin[1:], len(best)]
        made = {n: (best[a:b], score[a:b]) for n, a, b in zip(nodes.tolist(), begin, ends)}
        nothing = np.zeros(0, "<i8"), np.zeros(0, "<f4")
        out = []
        for home, n, vec in zip(own["home"], own["node"].tolist(), own["vec"]):
            ids, vals = made.get(n, nothing)
            new = np.fromiter(((n, i) not in old for i in ids.tolist()), np.uint8, len(ids))
            worst = float(vals[-1]) if len(vals) == degree else -np.inf
            out.append((home, n, vec, ids.tobytes(), vals.tobytes(), new.tobytes(), worst, int(new.sum())))
        return pd.DataFrame(out, columns=_names(STATE))

    return run


def _lists(rows: pd.DataFrame, turn: int, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the nodes of state rows list of their own neighbours: (v, member, fresh)."""
    v, member, fresh = [np.zeros(0, "<i8")], [np.zeros(0, "<i8")], [np.zeros(0, bool)]
    for n, ids, new in zip(rows["node"].tolist(), rows["ids"], rows["new"]):
        taken, old = _listed(ids, new, n, turn, sample)
        others = np.frombuffer(ids, "<i8")
        v.append(np.full(len(taken) + len(old), n))
        member += [others[taken], others[old]]
        fresh += [np.ones(len(taken), bool), np.zeros(len(old), bool)]
    return np.concatenate(v), np.concatenate(member), np.concatenate(fresh)


def _drawn(v: np.ndarray, member: np.ndarray, fresh: np.ndarray, turn: int, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every v at most ``sample`` fresh and as many other members, drawn by a hash, so a draw of draws is a draw."""
    mixed = (member.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (v.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(turn * 40503))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return _first((~fresh, v), (member, mixed ^ (mixed >> np.uint64(29))), (v, member, fresh), sample)


def _first(keys: tuple, by: tuple, columns: tuple, most: int) -> tuple:
    """The first ``most`` entries of every group of equal ``keys``, in the order of ``by`` (the last counts most, as in lexsort)."""
    order = np.lexsort((*by, *keys))
    keys = [k[order] for k in keys]
    apart = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    begin = np.flatnonzero(np.r_[True, apart][: len(order)])
    place = np.arange(len(order)) - np.repeat(begin, np.diff(np.r_[begin, len(order)]))
    return tuple(c[order[place < most]] for c in columns)


def _sent_home(v: np.ndarray, member: np.ndarray, mark: np.ndarray, blocks: int) -> pd.DataFrame:
    """One row for each home block of ``v``: its entries."""
    home = _homes(v, blocks)
    order = np.argsort(home, kind="stable")
    v, member, mark, home = v[order], member[order], mark[order], home[order]
    cells = [(home[a], v[a:b].tobytes(), member[a:b].tobytes(), mark[a:b].tobytes()) for a, b in zip(*_runs(home))]
    return pd.DataFrame(cells, columns=_names(NAMED))


def _naming(turn: int, sample: int, blocks: int):
    """State rows to what the home block of every listed node needs to know: (it, who lists it, fresh)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            v, member, fresh = _lists(rows, turn, sample)
            yield _sent_home(*_drawn(member, v, fresh, turn, sample), blocks)

    return run


def _with_asks(block: int, v: np.ndarray, member: np.ndarray, mark: np.ndarray, blocks: int) -> pd.DataFrame:
    """The lists of a block in one row, and for every home block a row of the nodes whose vectors they need, without ``v``."""
    names = np.unique(member)
    home = _homes(names, blocks)
    order = np.argsort(home, kind="stable")
    names, home = names[order], home[order]
    asks = [(home[a], block, None, names[a:b].tobytes(), None) for a, b in zip(*_runs(home))]
    return pd.DataFrame([(block, block, v.tobytes(), member.tobytes(), mark.tobytes()), *asks], columns=_names(LISTS))


def _listing(turn: int, sample: int, blocks: int):
    """A home block's state rows and who lists its nodes to its lists of a round, for every v the fresh members first."""

    def run(key: tuple, own: pd.DataFrame, naming: pd.DataFrame) -> pd.DataFrame:
        back = _drawn(_joined(naming["v"], "<i8"), _joined(naming["member"], "<i8"), _joined(naming["mark"], bool), turn, sample)
        v, member, fresh = (np.concatenate(x) for x in zip(_lists(own, turn, sample), back))
        order = np.lexsort((~fresh, v))
        return _with_asks(int(key[0]), v[order], member[order], fresh[order], blocks)

    return run


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in 16 bits an entry: (scales, codes)."""
    most = np.abs(x).max(axis=1, keepdims=True)
    scale = np.where(most > 0, most, 1).astype("<f4") / np.float32(32_767)
    return scale[:, 0], np.rint(x / scale).astype("<i2")


def _answer_block(asks: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
    """What blocks ask of a home block, and its nodes, to a row of vectors for each of them; the last entry stays whole."""
    if not len(asks) or not len(own):
        return pd.DataFrame(columns=_names(VECTORS))
    order = np.argsort(own["node"].to_numpy())
    names, worst = own["node"].to_numpy()[order], own["worst"].to_numpy()[order].astype("<f4")
    vecs = _joined(own["vec"], "<f4").reshape(len(own), -1)[order]
    scales, codes = _codes(vecs[:, :-1])
    out = []
    for block, wanted in zip(asks["block"], asks["member"]):
        at = np.searchsorted(names, np.frombuffer(wanted, "<i8"))
        out.append((block, names[at].tobytes(), scales[at].tobytes(), vecs[at, -1].tobytes(), codes[at].tobytes(), worst[at].tobytes()))
    return pd.DataFrame(out, columns=_names(VECTORS))


def _asked_vectors(made: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From what ``_with_asks`` made: (lists, vectors that they need)."""
    asks = made.filter("v IS NULL").select("home", "block", "member")
    own = state.select("home", "node", "vec", "worst")
    return made.filter("v IS NOT NULL"), asks.groupBy("home").cogroup(own.groupBy("home")).applyInPandas(_answer_block, VECTORS)


def _compare(degree: int, blocks: int):
    """One block: its lists and the vectors they name to the finds of every named node."""

    def run(lists: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=_names(FOUND))
        if not len(lists) or not len(vectors):
            return empty
        names = _joined(vectors["names"], "<i8")
        order = np.argsort(names)
        names, worst = names[order], _joined(vectors["worst"], "<f4")[order]
        codes = _joined(vectors["codes"], "<i2").reshape(len(names), -1)[order]
        vecs = np.c_[codes * _joined(vectors["scales"], "<f4")[order][:, None], _joined(vectors["lasts"], "<f4")[order]]
        del codes
        v, fresh = _joined(lists["v"], "<i8"), _joined(lists["mark"], bool)
        at = np.searchsorted(names, _joined(lists["member"], "<i8"))
        kept, to, found, val, held = [], [], [], [], 0

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            nodes, begin, other, score = _packed(*(np.concatenate([*(k[n] for k in kept), *x]) for n, x in enumerate((to, found, val))), degree)
            return np.repeat(nodes, np.diff(np.r_[begin, len(other)])), other, score

        for a, b in zip(*_runs(v)):
            mine = at[a:b]
            new = np.unique(mine[: int(fresh[a:b].sum())])
            if not len(new):
                continue
            all_ = np.r_[new, np.setdiff1d(mine, new)]
            score = vecs[new] @ vecs[all_].T
            i, j = np.nonzero((score > worst[new][:, None]) & (new[:, None] != all_[None]))
            to.append(new[i])
            found.append(all_[j])
            val.append(score[i, j])
            late = score[:, len(new) :]
            i, j = np.nonzero(late > worst[all_[len(new) :]][None])
            to.append(all_[len(new) :][j])
            found.append(new[i])
            val.append(late[i, j])
            held += len(to[-1]) + len(to[-2])
            if held > 500_000:
                kept, to, found, val, held = [best()], [], [], [], 0
        if not to and not kept:
            return empty
        to, found, val = best()
        begin, end = _runs(to)
        return _rows(_homes(names[to[begin]], blocks), names[to[begin]], end - begin, names[found], val.astype("<f4"))

    return run


def neighbour_graph(nodes: DataFrame, *, degree: int = DEGREE, sample: int = SAMPLE, settled: float = SETTLED) -> DataFrame:
    """State rows of (node, vec): every node with its best neighbours' ids and values, best first.

    Of a vector all entries but the last have one scale; the last may be of another size.
    """
    n = nodes.count()
    blocks, wide = -(-n // BLOCK) or 1, -(-n // START) or 1
    homed = nodes.mapInPandas(lambda batches: (rows.assign(home=_homes(rows["node"].to_numpy(), blocks)) for rows in batches), "node long, vec binary, home int")
    blank = homed.select("home", "node", "vec", *[F.lit(b"").alias(c) for c in ("ids", "vals", "new")], F.lit(float("-inf")).cast("float").alias("worst"), F.lit(0).alias("n_new"))
    deals = range(1 if wide == 1 else 2)
    near = [nodes.withColumn("deal", _block("node", wide, 100 + d)).groupBy("deal").applyInPandas(_within(degree // len(deals), blocks), FOUND) for d in deals]
    state = _merged(blank, near, -1, degree, sample, "graph")
    turn = 0
    while True:
        changed = state.agg(F.sum("n_new")).first()[0] or 0
        if wide == 1 and turn == 1 or changed <= settled * n * degree * (turn > 0):
            return state
        named = state.select("node", "ids", "new").mapInPandas(_naming(turn, sample, blocks), NAMED)
        made = state.select("home", "node", "ids", "new").groupBy("home").cogroup(named.groupBy("home")).applyInPandas(_listing(turn, sample, blocks), LISTS)
        made = materialize(made, "lists")
        lists, vectors = _asked_vectors(made, state)
        finds = lists.groupBy("home").cogroup(vectors.groupBy("block")).applyInPandas(_compare(degree, blocks), FOUND)
        after = _merged(state, [finds], turn, degree, sample, "graph")
        for done in (state, made):
            release(done)
        state, turn = after, turn + 1


def _merged(state: DataFrame, finds: list[DataFrame], turn: int, degree: int, sample: int, name: str) -> DataFrame:
    rows = state
    for f in finds:
        rows = rows.unionByName(f.withColumn("node", F.lit(0).cast("long")), allowMissingColumns=True)  # no null, or pandas makes them doubles
    return materialize(rows.groupBy("home").applyInPandas(_merge(turn, degree, sample), STATE), name)


def _links(state: DataFrame, degree: int, blocks: int, name: str) -> DataFrame:
    """(home, node, links, scales, codes): a node's neighbours, and of the nodes that name it the ``degree`` nearest, each with all its entries but the last in 16 bits.

    It is a table ``name`` of the catalog, bucketed by home, so grouping by home reads its files as they are.
    """

    def nearest(v: np.ndarray, member: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _first((v,), (member, -val), (v, member, val), degree)

    def naming(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            by = np.repeat(rows["node"].to_numpy("<i8"), rows["ids"].str.len().to_numpy("<i8") // 8)
            yield _sent_home(*nearest(_joined(rows["ids"], "<i8"), by, _joined(rows["vals"], "<f4")), blocks)

    def listing(key: tuple, own: pd.DataFrame, named: pd.DataFrame) -> pd.DataFrame:
        v, member, _ = nearest(_joined(named["v"], "<i8"), _joined(named["member"], "<i8"), _joined(named["mark"], "<f4"))
        by = np.repeat(own["node"].to_numpy("<i8"), own["ids"].str.len().to_numpy("<i8") // 8)
        both = np.unique(np.c_[np.r_[by, v], np.r_[_joined(own["ids"], "<i8"), member]], axis=0)
        return _with_asks(int(key[0]), both[:, 0], both[:, 1], np.zeros(0, bool), blocks)

    def packed(key: tuple, lists: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        names = _joined(vectors["names"], "<i8")
        if not len(names):
            return pd.DataFrame(columns=_names(LINKS))
        order = np.argsort(names)
        codes = _joined(vectors["codes"], "<i2").reshape(len(names), -1)
        v, member = _joined(lists["v"], "<i8"), _joined(lists["member"], "<i8")
        at = order[np.searchsorted(names[order], member)]
        scales = _joined(vectors["scales"], "<f4")
        cells = [(int(key[0]), v[a], member[a:b].tobytes(), scales[at[a:b]].tobytes(), codes[at[a:b]].tobytes()) for a, b in zip(*_runs(v))]
        return pd.DataFrame(cells, columns=_names(LINKS))

    named = state.select("node", "ids", "vals").mapInPandas(naming, NAMED)
    made = state.select("home", "node", "ids").groupBy("home").cogroup(named.groupBy("home")).applyInPandas(listing, LISTS)
    made = materialize(made, "lists")
    lists, vectors = _asked_vectors(made, state)
    links = lists.groupBy("home").cogroup(vectors.groupBy("block")).applyInPandas(packed, LINKS)
    spark = state.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // PER_TASK))
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}"
    links.repartition(tasks, "home").write.bucketBy(tasks, "home").format("parquet").option("path", path).saveAsTable(name)
    release(made)
    return spark.table(name)


def _requests(blocks: int, beam: int, parts: dict[int, int]):
    """Searches to one row for each block (and part of a much asked one) that has nodes they follow: the queries, and who follows what."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            which = np.repeat(np.arange(len(rows)), rows["wanted"].str.len().to_numpy("<i8") // 8)
            node = _joined(rows["wanted"], "<i8")
            query, block = rows["query"].to_numpy("<i8"), rows["block"].to_numpy("<i4")
            vecs = _joined(rows["vec"], "<f4").reshape(len(rows), -1)
            worst = np.array([np.frombuffer(v, "<f4")[-1] if len(v) >= 4 * beam else -np.inf for v in rows["vals"]], "<f4")
            home = _homes(node, blocks)
            part = query[which] % np.array([parts.get(h, 1) for h in home.tolist()], "<i8")
            order = np.lexsort((which, part, home))
            which, node, home, part = which[order], node[order], home[order], part[order]
            begin = np.flatnonzero(np.r_[True, (home[1:] != home[:-1]) | (part[1:] != part[:-1])][: len(home)])
            cells = []
            for a, b in zip(begin, np.r_[begin[1:], len(home)]):
                own, at = np.unique(which[a:b], return_inverse=True)
                cells.append((home[a], part[a], *(x[own].tobytes() for x in (query, block, vecs, worst)), at.astype("<i4").tobytes(), node[a:b].tobytes()))
            yield pd.DataFrame(cells, columns=_names(ASKED))

    return run


def _answer_queries(asked: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """What queries follow in a block, and its links, to the links that their beams have room for, by block of queries."""
    at = {n: i for i, n in enumerate(links["node"].tolist())}
    ids, scales, codes = (links[c].to_numpy() for c in ("links", "scales", "codes"))
    block, query, count, found, val = [], [], [], [np.zeros(0, "<i8")], [np.zeros(0, "<f4")]
    for row in asked.itertuples(index=False):
        queries, blocks, worst = np.frombuffer(row.queries, "<i8"), np.frombuffer(row.blocks, "<i4"), np.frombuffer(row.worst, "<f4")
        vecs = np.frombuffer(row.vecs, "<f4").reshape(len(queries), -1)
        for q, n in zip(np.frombuffer(row.which, "<i4").tolist(), np.frombuffer(row.nodes, "<i8").tolist()):
            if n not in at:
                continue
            i = at[n]
            value = np.frombuffer(codes[i], "<i2").reshape(-1, vecs.shape[1]).astype("<f4") @ vecs[q] * np.frombuffer(scales[i], "<f4")
            room = value >= worst[q]
            found.append(np.frombuffer(ids[i], "<i8")[room])
            val.append(value[room])
            block.append(blocks[q])
            query.append(queries[q])
            count.append(len(found[-1]))
    return _rows(np.array(block, "<i4"), np.array(query, "<i8"), np.array(count, "<i4"), np.concatenate(found), np.concatenate(val).astype("<f4"))


def _step(beam: int, followed: int):
    """One block of queries with the links that were met: keep the best, then name the nodes to follow next.

    A node that left the beam can't come back, since the beam's worst value only rises.
    """

    def run(queries: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        asker = np.repeat(_joined(answers["nodes"], "<i8"), _joined(answers["counts"], "<i4"))
        order = np.argsort(asker, kind="stable")
        asker, answer, value = asker[order], _joined(answers["ids"], "<i8")[order], _joined(answers["vals"], "<f4")[order]
        out = []
        for row in queries.itertuples(index=False):
            ids, vals, done = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.vals, "<f4"), np.frombuffer(row.followed, np.uint8) > 0
            a, b = np.searchsorted(asker, row.query), np.searchsorted(asker, row.query, "right")
            met, first = np.unique(answer[a:b], return_index=True)
            new = ~np.isin(met, ids)
            met, first = met[new], first[new]
            ids, vals, done = np.r_[ids, met], np.r_[vals, value[a:b][first]], np.r_[done, np.zeros(len(met), bool)]
            best = np.lexsort((ids, -vals))[:beam]
            ids, vals, done = ids[best], vals[best], done[best]
            open_ = np.flatnonzero(~done)[:followed]
            done[open_] = True
            out.append((row.query, row.vec, ids.tobytes(), vals.tobytes(), done.astype(np.uint8).tobytes(), ids[open_].tobytes(), len(open_)))
        return pd.DataFrame(out, columns=_names(SEARCH))

    return run


def graph_search(links: DataFrame, queries: DataFrame, *, blocks: int, beam: int = BEAM, followed: int = FOLLOWED) -> DataFrame:
    """(query, node, val): the best nodes that a greedy search from each query's own node meets, its own among them.

    ``queries`` has (query, vec), query being the node; ``blocks`` is the number of home blocks. Finished queries leave the rounds.
    """
    n = queries.count()
    deal = _block("query", -(-n // ASKING) or 1, 2)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            own = [np.array([q], "<i8").tobytes() for q in rows["query"]]
            vecs = [np.frombuffer(v, "<f4") for v in rows["vec"]]
            yield rows.assign(ids=own, vals=[np.array([v @ v], "<f4").tobytes() for v in vecs], followed=b"\x01", wanted=own, n_open=1)

    def per_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            home, count = np.unique(_homes(_joined(rows["wanted"], "<i8"), blocks), return_counts=True)
            yield pd.DataFrame({"home": home, "n": count})

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                times = rows["ids"].str.len().to_numpy() // 8
                yield pd.DataFrame({"query": np.repeat(rows["query"].to_numpy(), times), "node": _joined(rows["ids"], "<i8"), "val": _joined(rows["vals"], "<f4")})

    state = materialize(queries.select("query", "vec").mapInPandas(begin, SEARCH), "search")
    ended = []
    while True:
        left = state.filter("n_open > 0").withColumn("block", deal)
        ended.append(materialize(state.filter("n_open = 0").select("query", "ids", "vals").mapInPandas(best, "query long, node long, val float"), "found"))
        asked = left.select("wanted").mapInPandas(per_home, "home int, n long").groupBy("home").agg(F.sum("n").alias("n"))
        much = asked.agg(F.max("n")).first()[0]
        if not much:
            break
        keys, there, parts = ["home"], links, {}
        if much > ANSWERED:  # the requests to a block meet copies of it
            parts = {r["home"]: -(-r["n"] // ANSWERED) for r in asked.filter(F.col("n") > ANSWERED).collect()}
            copies = F.coalesce(F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])[F.col("home")], F.lit(1))
            keys, there = ["home", "part"], links.withColumn("part", F.explode(F.sequence(F.lit(0), copies.cast("int") - 1)))
        requests = left.mapInPandas(_requests(blocks, beam, parts), ASKED)
        answers = requests.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(_answer_queries, FOUND)
        after = left.groupBy("block").cogroup(answers.groupBy("home")).applyInPandas(_step(beam, followed), SEARCH)
        after = materialize(after, "search")
        release(state)
        state = after
    found = ended[0]
    for part in ended[1:]:
        found = found.unionByName(part)
    return found


def nearest_neighbours(
    rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", is_query: Column | None = None, k: int = 20,
    degree: int = DEGREE, beam: int = BEAM,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other ids found for every query row, by inner product, ties by the smaller id.

    ``is_query`` picks the queries (default: ids divisible by 20). Rows without id, and vectors that
    are null, empty, zero or hold a null or non-finite entry take no part; shorter vectors count as
    ending in zeros. Equal vectors are one node with their k + 1 smallest ids, so copies don't crowd
    the graph. A row that repeats id and vector counts once; an id with several vectors counts
    with its best one, and isn't its own neighbour. With fewer than k other ids all of them are
    returned as far as found. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    spark = rows.sparkSession
    asks = F.coalesce(F.col(f"`{id_col}`") % 20 == 0 if is_query is None else is_query, F.lit(False))
    chosen = rows.select(F.col(f"`{id_col}`").alias("vec_id"), doubles(F.col(f"`{vector_col}`")).alias("vector"), asks.alias("asks"))
    sound = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0)
    chosen = chosen.filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    top = chosen.agg(F.max(F.size("vector")).alias("dims"), F.max(F.sqrt(dot(F.col("vector"), F.col("vector")))).alias("norm")).first()
    if top["dims"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, norm = top["dims"], top["norm"]
    padded = F.transform(F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("vector"))), lambda c: c + F.lit(0.0))  # -0.0 is 0.0
    one = materialize(chosen.select("vec_id", padded.alias("vector"), "asks").groupBy("vec_id", "vector").agg(F.max("asks").alias("asks")), "vectors")

    distinct = one.groupBy("vector").agg(F.max("asks").alias("asks")).withColumn("node", F.monotonically_increasing_id())
    distinct = materialize(distinct, "distinct")  # the numbers stand once they are written

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                x = np.stack(part["vector"].to_numpy()) / norm
                more = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
                made = np.c_[x, more].astype("<f4")
                yield pd.DataFrame({"node": part["node"], "vec": [v.tobytes() for v in made], "asks": part["asks"]})

    nodes = materialize(distinct.select("node", "vector", "asks").mapInPandas(packed, "node long, vec binary, asks boolean"), "nodes")
    state = neighbour_graph(nodes.select("node", "vec"), degree=degree)
    blocks, name = -(-nodes.count() // BLOCK) or 1, f"links_{uuid.uuid4().hex}"
    links = _links(state, degree, blocks, name)
    release(state)
    queries = nodes.filter("asks").select(F.col("node").alias("query"), F.substring("vec", F.lit(1), F.lit(4 * dims)).alias("vec"))
    found = graph_search(links, queries, blocks=blocks, beam=beam)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("val").desc(), "node"))
    found = materialize(found.withColumn("place", place).filter(F.col("place") <= RESCORED).select("query", "node"), "rescored")
    release(links)
    spark.sql(f"DROP TABLE {name}")

    # Exact scores of the found nodes, then their ids: of a node the k + 1 smallest are enough.
    side = lambda name: distinct.select(F.col("node").alias(name), F.col("vector").alias(f"{name}_vector"))
    scored = found.join(side("node"), "node").join(side("query"), "query").select("query", "node", dot(F.col("query_vector"), F.col("node_vector")).alias("score"))
    member = one.join(distinct.select("vector", "node"), "vector").select("node", "vec_id", "asks")
    member = materialize(member, "members")
    nth = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    few = member.select("node", "vec_id").withColumn("nth", nth).filter(F.col("nth") <= k + 1).drop("nth")
    per_id = scored.join(few, "node").groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    ranked = per_id.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("place") <= k + 1)
    listed = ranked.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))  # k + 1 at most
    asking = member.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    out = asking.join(listed, "query").select("query_id", F.posexplode(others).alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
