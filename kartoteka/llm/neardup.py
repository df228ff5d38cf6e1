"""MinHash near-duplicates by a chosen-path similarity join.

Each document is a set of word shingles. Equal sets form one class and go on as one. Independent trees branch the classes
by selected minwise tokens: a node's members share the tokens chosen on its path, and a node with many members is branched
again by further tokens, drawn by the node's name. Members of small nodes are compared with each other by their signatures.
Members of a large node are compared with a few of its members, its centres: those that resemble one are gathered, those that
are very like one are branched no more, and a node all of whose members resemble a centre is done. So is a node of which few
members do not resemble the least one: all its members are compared with those. What could be similar is gathered, and every
link is confirmed on full sets.

A pair at the threshold of 0.8 shares a node of the first level in one of three trees but for 0.2 ** 9 of cases, and one of
the third level but for about 4e-6. A document that is branched no more has at least 24 of 32 tokens of a centre; one that is
linked with it then resembles that centre in 9 of 10 cases, and the pair meets in some seven nodes with centres of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.llm import _common as C
from kartoteka.llm.components import components

#: Trees, and branches of each of a tree's nodes by level; nodes of the last level have none.
TREES, CHOSEN = 3, (3, 2, 2, 2, 2, 2)
#: Members of a large node that its others are compared with: the least one, and others that the node's name draws.
CENTRES = 4
#: Minwise tokens of a signature: the first are the trees' roots, a deeper branch takes the one that its node's name draws.
TOKENS = 48
#: Members of a small node are compared by so many of them.
COMPARED = 32
#: Equal ones of those that a pair must have to be looked at further; a pair at 0.8 has fewer in one of a million cases.
LEAST_EQUAL = 14
#: Equal ones with a centre from which on a member is branched no more.
VERY_LIKE = 24
#: A node of at most so many members is compared exhaustively, a larger one is branched, unless so few are unlike its least one.
SMALL = 48
#: Shingles of sets that are compared in one task.
BLOCK = 2_000_000
#: Members of a group of many blocks that all its blocks see.
LEADERS = 64
#: Bytes of a broadcast row of ids and small numbers.
ID_ROW_BYTES = 64

_rng = np.random.default_rng(20)
MULTIPLIERS = _rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts, k: int) -> list[np.ndarray]:
    """Ascending distinct 64-bit hashes of each text's k-word shingles; of all its words if it has fewer than k."""
    words, counts = C.word_hashes(texts, lower=True)
    out, at = [], 0
    for n in counts.tolist():
        size = min(n, k)
        out.append(np.unique(C.rolling(words[at : at + n], size, size)) if n else np.empty(0, np.uint64))
        at += n
    return out


def _signed(batches, k: int):
    for b in batches:
        at = 0
        for part in C.slices(b["text"].tolist()):
            ids = b["doc_id"].iloc[at : at + len(part)]
            at += len(part)
            yield _signed_part(ids, part, k)


def _signed_part(ids: pd.Series, texts: list[str], k: int) -> pd.DataFrame:
    sets = shingle_sets(texts, k)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    full = np.flatnonzero(sizes)
    x = np.concatenate([np.empty(0, np.uint64), *sets])
    starts = (np.cumsum(sizes) - sizes)[full]
    sig = np.zeros((len(sets), TOKENS), np.int32)
    names = np.zeros((len(sets), 2), np.int64)
    if len(full):
        for t, a in enumerate(MULTIPLIERS):
            sig[full, t] = (np.minimum.reduceat(x * a, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        for i, salt in enumerate((3, 5)):
            names[full, i] = np.add.reduceat(C.mixed(x ^ np.uint64(salt)), starts).view(np.int64)
    return pd.DataFrame({"doc_id": ids.to_numpy(), "n_shingles": sizes, "s1": names[:, 0], "s2": names[:, 1], "sig": list(sig)})


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (which name the set), sig of every row; a text without words has no shingle."""
    C.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(
        lambda batches: _signed(batches, k), "doc_id long, n_shingles long, s1 long, s2 long, sig array<int>"
    )


def _branch(node: Column | str, b: int) -> Column:
    """The place in the signature of a node's branch b: behind the roots', drawn by the node's name, another one for each b."""
    roots = TREES * CHOSEN[0]
    n = TOKENS - roots
    step = F.lit(1) + F.pmod(F.xxhash64(node, F.lit(1)), F.lit(n - 1))
    return (F.lit(roots) + F.pmod(F.pmod(F.xxhash64(node), F.lit(n)) + F.lit(b) * step, F.lit(n))).cast("int")


def _children(members: DataFrame, chosen: int) -> DataFrame:
    """(node, doc_id) of the branches of members (node, doc_id, sig)."""
    nodes = [F.xxhash64("node", F.lit(b), F.get("sig", _branch("node", b))) for b in range(chosen)]
    return members.select("doc_id", F.explode(F.array(*nodes)).alias("node"))


def _equal_tokens(a: Column, b: Column) -> Column:
    """How many of the first COMPARED tokens of two signatures are equal."""
    same = F.zip_with(F.slice(a, 1, COMPARED), F.slice(b, 1, COMPARED), lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x)


def leaves(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, doc_id) of the small nodes that are to be compared, and (a, b) of gathered classes with the least of a large node.

    Sizes of nodes and their centres are written before they are joined, so that a hot node's members can be split among tasks
    by adaptive execution.
    """
    sigs = classes.select("doc_id", "sig")
    roots = [F.xxhash64(F.lit(t), F.get("sig", t)) for t in range(TREES * CHOSEN[0])]
    small, stars = [], []
    level = sigs.select("doc_id", F.explode(F.array(*roots)).alias("node"))
    drawn = [F.min_by("doc_id", F.xxhash64("doc_id", "node", F.lit(j))) for j in range(1, CENTRES)]
    for chosen in (*CHOSEN[1:], 0):
        sizes = C.written(level.groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.array(*drawn).alias("drawn")).where("n >= 2"), "sizes")
        # written, so that each level is one small plan
        sized = C.written(level.join(sizes.select("node", "n", "least"), "node"), "level")
        small.append(sized.where(F.col("n") <= SMALL).select("node", "doc_id"))
        large = sized.where(F.col("n") > SMALL).select("node", "doc_id", "least")
        if large.isEmpty():
            break
        centres = sizes.where(F.col("n") > SMALL).select("node", F.explode(F.array_distinct(F.concat(F.array("least"), "drawn"))).alias("doc_id"))
        named = C.written(centres.join(sigs, "doc_id").groupBy("node").agg(F.collect_list(F.struct(F.col("doc_id").alias("id"), F.slice("sig", 1, COMPARED).alias("sig"))).alias("centres")), "centres")
        scores = F.transform("centres", lambda c: F.struct(_equal_tokens(F.col("sig"), c["sig"]).alias("equal"), c["id"].alias("id")))
        scored = large.join(sigs, "doc_id").join(named, "node").withColumn("scores", scores)
        with_least = F.get(F.filter("scores", lambda x: x["id"] == F.col("least")), 0)["equal"]
        most = F.array_max("scores")
        found = C.written(scored.select("node", "doc_id", "least", "sig", with_least.alias("with_least"), most["equal"].alias("equal"), most["id"].alias("centre")), "members")
        # a member is gathered with the node's least one if it resembles that, else with the centre that it resembles most; of
        # the last level, all are with the least one
        to = F.when(F.lit(not chosen) | (F.col("with_least") >= LEAST_EQUAL), F.col("least")).when(F.col("equal") >= LEAST_EQUAL, F.col("centre"))
        stars.append(found.select(F.col("doc_id").alias("a"), to.alias("b")).where("a != b"))
        if not chosen:
            break
        is_apart = F.col("with_least") < LEAST_EQUAL
        counts = C.written(found.where(is_apart).groupBy("node").agg(F.count("*").alias("apart"), F.min("equal").alias("equal")), "counts")
        few = counts.where(F.col("apart") <= SMALL).select("node")
        apart = C.written(found.where(is_apart).join(few, "node").groupBy("node").agg(F.collect_list(F.struct(F.col("doc_id").alias("id"), F.slice("sig", 1, COMPARED).alias("sig"))).alias("apart")), "apart")
        like = F.filter("apart", lambda x: _equal_tokens(F.col("sig"), x["sig"]) >= LEAST_EQUAL)
        # of those that are with the least one, one that resembles it tells as much as all
        own = F.when(is_apart, F.col("doc_id")).otherwise(F.col("least"))
        met = found.join(apart, "node").select("node", own.alias("own"), "doc_id", F.explode(F.transform(like, lambda x: x["id"])).alias("b"))
        stars.append(met.where("doc_id != b").groupBy("node", "own", "b").agg(F.min("doc_id").alias("a")).select("a", "b"))
        open_nodes = counts.where((F.col("apart") > SMALL) & (F.col("equal") < LEAST_EQUAL)).select("node")
        # written, as it is both counted and joined with the counts
        level = C.written(_children(found.where(F.col("equal") < VERY_LIKE).join(open_nodes, "node", "left_semi"), chosen), "children")
    none = classes.sparkSession.createDataFrame([], "a long, b long")
    return _union(small), _union([none, *stars])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _alike(rows: pd.DataFrame) -> pd.DataFrame:
    """(a, b) for members of each small node that are connected by pairs with enough equal tokens; b is the least of them."""
    rows = rows.sort_values(["node", "doc_id"], ignore_index=True)
    node, ids = rows["node"].to_numpy(), rows["doc_id"].to_numpy()
    sig = np.stack(rows["sig"].to_list())
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    sizes = np.diff(np.r_[starts, len(node)])
    a, b = [], []
    for m in np.unique(sizes[sizes > 1]):
        those = starts[sizes == m]
        step = max(1, (1 << 22) // int(m * m * COMPARED))
        for k in range(0, len(those), step):
            at = those[k : k + step, None] + np.arange(m)
            s = sig[at]
            match = (s[:, :, None] == s[:, None]).sum(3) >= LEAST_EQUAL
            label = np.broadcast_to(np.arange(m), at.shape).copy()
            while True:  # least labels spread over matches
                least = np.where(match, label[:, None, :], m).min(2)
                if (least == label).all():
                    break
                label = least
            i, j = np.nonzero(label != np.arange(m))
            a.append(ids[at[i, j]])
            b.append(ids[at[i, label[i, j]]])
    return pd.DataFrame({"a": np.concatenate([np.empty(0, np.int64), *a]), "b": np.concatenate([np.empty(0, np.int64), *b])})


def candidates(classes: DataFrame, rows: int) -> DataFrame:
    """Edges (a, b) between classes that may be similar; members of a node that no path divides are joined to its least."""
    small, stars = leaves(classes)
    parts = max(C.width(classes.sparkSession), -(-rows // 20_000))
    signed = small.join(classes.select("doc_id", F.slice("sig", 1, COMPARED).alias("sig")), "doc_id")
    alike = signed.groupBy(F.pmod(F.xxhash64("node"), F.lit(parts)).alias("part")).applyInPandas(lambda x: _alike(x), "a long, b long")
    return alike.unionByName(stars).distinct()


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] values, then those of the next start."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class _Group:
    """Sets that are compared with each other; labels of linked ones become one. Pairs with equal labels need no look.

    Tokens are ordered from rare to common. Two linked sets share one among the rarest (1 - threshold) of each, so a set
    is compared with those that the postings of its rarest tokens give, if sizes and places there leave enough in common.
    """

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, least: tuple[int, int]):
        self.labels, (self.num, self.den) = labels, least
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        _, token, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(n), np.int64)
        rank[np.argsort(n, kind="stable")] = np.arange(len(n))
        set_of = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(set_of * len(n) + rank[token])
        self.x = rank[token][order]
        self.starts = np.cumsum(self.sizes) - self.sizes
        #: How much of each set others have too.
        self.shared = np.add.reduceat((n[token] > 1).astype(np.int64), self.starts) / self.sizes
        self.rarest = self.sizes - -(-self.num * self.sizes // self.den) + 1
        at = _ranges(self.starts, self.rarest)
        by_token = np.argsort(self.x[at], kind="stable")
        self.of = np.repeat(np.arange(len(sets)), self.rarest)[by_token]
        self.place = (at - np.repeat(self.starts, self.rarest))[by_token]
        self.first = np.searchsorted(self.x[at][by_token], np.arange(len(n) + 1))
        self.mark = np.zeros(len(n), bool)

    def look(self, i: int) -> None:
        """Compares set i with all that it can be linked with and gives all that are linked its own or their least label."""
        size, own = int(self.sizes[i]), self.x[self.starts[i] : self.starts[i] + self.sizes[i]]
        rare = own[: self.rarest[i]]
        n = self.first[rare + 1] - self.first[rare]
        posting = _ranges(self.first[rare], n)
        # of postings of one set, the first is the rarest token in common
        others, k = np.unique(self.of[posting], return_index=True)
        before, theirs, sizes = np.repeat(np.arange(len(rare)), n)[k], self.place[posting][k], self.sizes[others]
        enough = np.minimum(size - before, sizes - theirs) * (self.num + self.den) >= self.num * (size + sizes)
        others = others[enough & (self.labels[others] != self.labels[i])]
        if not len(others):
            return
        sizes = self.sizes[others]
        self.mark[own] = True
        both = np.add.reduceat(self.mark[self.x[_ranges(self.starts[others], sizes)]].astype(np.int64), np.cumsum(sizes) - sizes)
        self.mark[own] = False
        linked = both * self.den >= self.num * (sizes + size - both)
        if linked.any():
            met = np.unique(np.append(self.labels[others[linked]], self.labels[i]))
            self.labels[np.isin(self.labels, met)] = met[0]

    def settle(self, own: np.ndarray) -> None:
        """Looks with the sets `own` until each pair of one of them with any set is known to have one label or not to be linked.

        If all are own, one of a pair has to look, so those of the commonest label are spared. Sets that share most with
        others look first, as they link most.
        """
        seen = np.zeros(len(self.sizes), bool)
        order = np.argsort(-self.shared, kind="stable")
        while True:
            names, n = np.unique(self.labels, return_counts=True)
            if len(names) == 1:
                return
            todo = own & ~seen
            if own.all():
                todo &= self.labels != names[np.argmax(n)]
            if not todo.any():
                return
            i = int(order[np.argmax(todo[order])])
            seen[i] = True
            self.look(i)


def _linked(rows: pd.DataFrame, least: tuple[int, int]) -> pd.DataFrame:
    """(doc_id, label) of the sets of each group (g, block, chunk); sets with ask=False are compared with the others only."""
    out = []
    for _, g in rows.groupby(["g", "block", "chunk"], sort=False):
        g = g.sort_values(["doc_id", "ask"], ascending=[True, False]).drop_duplicates("doc_id")
        ids = g["doc_id"].to_numpy()
        group = _Group([np.frombuffer(x, np.uint64) for x in g["shingles"]], g["label"].to_numpy().copy(), least)
        group.settle(g["ask"].to_numpy())
        out.append(pd.DataFrame({"a": ids, "b": group.labels}))
    edges = pd.concat(out) if out else pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    return edges[edges["a"] != edges["b"]]


def _with_ids(df: DataFrame, ids: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """Rows of df whose key is in ids, with ids' columns, which are n rows of a few numbers: broadcast only if small in bytes."""
    return df.join(F.broadcast(ids) if n * ID_ROW_BYTES <= C.BROADCAST_BYTES else ids, key)


def _may_be_linked(outside: DataFrame, members: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(g, doc_id) of the sets of `outside` that have enough shingles in common with other members of their group to be linked.

    Shingles are counted over all members of the group, with partial sums before the shuffle.
    """

    def tokens(batches):
        for b in batches:
            sets = [np.frombuffer(x, np.int64) for x in b["shingles"]]
            sizes = [len(x) for x in sets]
            yield pd.DataFrame({"g": np.repeat(b["g"].to_numpy(), sizes), "doc_id": np.repeat(b["doc_id"].to_numpy(), sizes), "token": np.concatenate([np.empty(0, np.int64), *sets])})

    schema = "g long, doc_id long, token long"
    asked = outside.select("g", "doc_id", "shingles").mapInPandas(tokens, schema)
    met = members.select("g", "doc_id", "shingles").mapInPandas(tokens, schema).groupBy("g", "token").agg(F.count("*").alias("n")).where("n > 1").select("g", "token")
    there = asked.join(met, ["g", "token"]).groupBy("g", "doc_id").agg(F.count("*").alias("met"))
    return outside.select("g", "doc_id", "n_shingles").join(there, ["g", "doc_id"]).where(F.col("met") * least[1] >= F.col("n_shingles") * least[0]).select("g", "doc_id")


def confirmed(docs: DataFrame, classes: DataFrame, groups: DataFrame, k: int, least: tuple[int, int]) -> DataFrame:
    """(node, component): the groups' members by links that full sets confirm.

    A group of at most BLOCK shingles is compared in one task. A larger one is dealt by a hash into blocks, which share some
    leaders; then members outside the group's commonest component meet all its blocks, but for those that have too few
    shingles which any other member has, and so no link.
    """
    spark = docs.sparkSession
    sized = C.written(groups.join(classes.select(F.col("doc_id").alias("node"), "n_shingles"), "node"), "groups")
    totals = sized.groupBy("component").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("members"))
    blocks = totals.select("component", "members", F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks"))
    placed = C.written(sized.join(blocks, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("g"), "members", "blocks", "n_shingles"), "placed")
    n = placed.count()
    many = placed.where("blocks > 1").limit(1).count() > 0
    total = placed.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(C.width(spark), -(-total * 2 // BLOCK))

    def with_sets(wanted: DataFrame, rows: int) -> DataFrame:
        def sets(batches):
            for b in batches:
                at = 0
                for part in C.slices(b["text"].tolist()):
                    own = b.iloc[at : at + len(part)].drop(columns="text")
                    at += len(part)
                    yield own.assign(shingles=[x.tobytes() for x in shingle_sets(part, k)])

        found = _with_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null"), wanted, rows)
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.drop("text").schema)
        return found.mapInPandas(sets, fields + ", shingles binary")

    hashed = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 40))
    leader = (F.col("blocks") > 1) & (hashed < F.lit(LEADERS * float(1 << 40)) / F.col("members"))
    own_block = F.pmod(hashed, F.col("blocks")).cast("int")
    first = with_sets(placed, n).select(
        "doc_id", "g", F.explode(F.when(leader, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own_block))).alias("block"),
        F.lit(0).alias("chunk"), F.col("doc_id").alias("label"), F.lit(True).alias("ask"), "shingles",
    )

    def compared(rows: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("g", "block", "chunk"), F.lit(parts)).alias("part")
        return rows.groupBy(part).applyInPandas(lambda x: _linked(x, least), "a long, b long")

    links = C.written(compared(first), "links")
    if not many:
        return links.toDF("node", "component")
    labels = components(links)
    named = placed.where("blocks > 1").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "g", "members", "blocks", "n_shingles", F.coalesce("component", "doc_id").alias("label"))
    named = C.written(named, "named")
    commonest = named.groupBy("g", "label").agg(F.count("*").alias("n")).groupBy("g").agg(F.max_by("label", "n").alias("common"))
    outside = named.join(F.broadcast(commonest) if commonest.count() * ID_ROW_BYTES <= C.BROADCAST_BYTES else commonest, "g")
    outside = outside.withColumn("out", F.col("label") != F.col("common")).drop("common")
    found = C.written(with_sets(outside, named.count()), "sets")
    asking = C.written(_may_be_linked(found.where("out"), found, least), "asking")
    chunks = asking.join(named.select("g", "doc_id", "n_shingles"), ["g", "doc_id"]).groupBy("g").agg(F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("chunks"))
    sets = C.written(found.join(asking.withColumn("asks", F.lit(True)), ["g", "doc_id"], "left").withColumn("out", F.col("asks").isNotNull()).drop("asks").join(chunks, "g"), "sets")
    chunk = F.pmod(hashed, F.col("chunks")).cast("int")
    asked = sets.where("out").select("doc_id", "g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), chunk.alias("chunk"), "label", F.lit(True).alias("ask"), "shingles")
    rest = sets.where("not out").select("doc_id", "g", own_block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "label", F.lit(False).alias("ask"), "shingles")
    # those that ask meet those of other chunks in the block that is their own
    others = sets.where("out").select("doc_id", "g", own_block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "label", F.lit(False).alias("ask"), "shingles")
    more = compared(asked.unionByName(others).unionByName(rest))
    return components(C.written(links.unionByName(more), "links"))


def near_duplicates(docs: DataFrame, k: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of doc_id and text.

    Two documents are linked if the share of common shingles among all shingles of both is at least least[0] / least[1].
    component_id is the least id that links reach. A text without words is linked with nothing; repeated rows are copies;
    rows with one id and different texts count as linked; a null id is never the least, unless it has no other. An empty table
    gives an empty one; a long text's shingles are all taken.
    """
    signed = C.written(signatures(docs, k), "signed")
    full = signed.where("n_shingles > 0")
    named = C.written(full.groupBy("s1", "s2").agg(F.min_by(F.struct("doc_id", "n_shingles", "sig"), "doc_id").alias("x")).select("s1", "s2", "x.*").where("doc_id is not null"), "classes")
    classes = named.dropDuplicates(["doc_id"])
    edges = C.written(candidates(classes, named.count()), "candidates")
    linked = confirmed(docs, classes, components(edges), k, least)
    rep = named.select("s1", "s2", F.col("doc_id").alias("rep")).join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    found = signed.join(rep, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
