"""Parent-child rows to hierarchies: levels, paths, depths, roots, descendants and loops."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .components import connected_components

LOOP, BELOW_LOOP = "(loop)", "(below loop)"

#: Components of up to so many links are peeled whole inside one task; larger ones are peeled by joins, level by level.
TASK_LINKS = 50_000
#: Pairs of a node and a root that a task holds at once; the roots of a component are taken in groups of so many.
TASK_CELLS = 2_000_000


class Peeled:
    """Some whole components in memory, peeled from the leaves; children and parents by node."""

    def __init__(self, child: list[str], parent: list[str]):
        self.up: dict[str, list[str]] = defaultdict(list)
        self.down: dict[str, list[str]] = defaultdict(list)
        for c, p in zip(child, parent, strict=True):
            self.up[c].append(p)
            self.down[p].append(c)
        self.nodes = self.up.keys() | self.down.keys()
        left = {n: len(self.down.get(n, ())) for n in self.nodes}
        level, self.levels, self.level = [n for n in self.nodes if not left[n]], [], {}
        while level:
            for n in level:
                self.level[n] = len(self.levels)
            self.levels.append(level)
            nxt = []
            for n in level:
                for p in self.up.get(n, ()):
                    left[p] -= 1
                    if not left[p]:
                        nxt.append(p)
            level = nxt
        self.residual = self.nodes - self.level.keys()

    def loops(self) -> set[str]:
        """Nodes of the residual that reach themselves: its strongly connected parts with a link inside."""
        found, index, low, stack, on = set(), {}, {}, [], set()
        for start in self.residual:
            if start in index:
                continue
            work = [(start, iter([p for p in self.up.get(start, ()) if p in self.residual]))]
            index[start] = low[start] = len(index)
            stack.append(start)
            on.add(start)
            while work:
                n, ps = work[-1]
                for p in ps:
                    if p not in index:
                        index[p] = low[p] = len(index)
                        stack.append(p)
                        on.add(p)
                        work.append((p, iter([q for q in self.up.get(p, ()) if q in self.residual])))
                        break
                    if p in on:
                        low[n] = min(low[n], index[p])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[n])
                    if low[n] == index[n]:
                        part = []
                        while True:
                            x = stack.pop()
                            on.discard(x)
                            part.append(x)
                            if x == n:
                                break
                        if len(part) > 1 or n in self.up.get(n, ()):
                            found.update(part)
        return found

    def below(self, above: set[str]) -> set[str]:
        seen, work = set(), list(above)
        while work:
            for c in self.down.get(work.pop(), ()):
                if c not in seen:
                    seen.add(c)
                    work.append(c)
        return seen - above

    def depths(self, cells: int = TASK_CELLS) -> Iterator[dict[str, dict[str, tuple[int, str | None]]]]:
        """node -> root -> (fewest steps, parent on that way), for some of the roots at a time: the residual by widening rings, then the peeled nodes in reverse peel order."""
        tops = sorted(n for n in self.nodes if not self.up.get(n))
        size = max(1, cells // max(1, len(self.nodes)))
        for at in range(0, len(tops), size):
            yield self._depths_from(tops[at : at + size])

    def _depths_from(self, tops: list[str]) -> dict[str, dict[str, tuple[int, str | None]]]:
        got: dict[str, dict[str, tuple[int, str | None]]] = defaultdict(dict)
        for n in tops:
            got[n][n] = (0, None)
        ring = {(n, n) for n in tops if n in self.residual}
        steps = 0
        while ring:
            steps += 1
            reach: dict[tuple[str, str], str] = {}
            for n, root in ring:
                for c in self.down.get(n, ()):
                    if c in self.residual and root not in got[c]:
                        reach[c, root] = min(n, reach.get((c, root), n))
            for (c, root), n in reach.items():
                got[c][root] = (steps, n)
            ring = set(reach)
        for level in reversed(self.levels):
            for n in level:
                for p in self.up.get(n, ()):
                    above = got.get(p)
                    if not above:
                        continue
                    mine = got[n]
                    for root, (d, _) in above.items():
                        if root not in mine or (d + 1, p) < mine[root]:
                            mine[root] = (d + 1, p)
        return got

    def descendants(self) -> Iterator[tuple[str, dict[str, int]]]:
        """(node, descendant -> fewest steps): leaves send their lists to their parents; a list is let go once its node is peeled and sent."""
        lists: dict[str, dict[str, int]] = defaultdict(dict)
        for level in self.levels:
            for n in level:
                own = lists.pop(n, {})
                yield n, own
                for p in self.up.get(n, ()):
                    to = lists[p]
                    if to.get(n, 1 << 30) > 1:
                        to[n] = 1
                    for d, s in own.items():
                        if s + 1 < to.get(d, 1 << 30):
                            to[d] = s + 1
        yield from self.descendants_of(self.residual)

    def descendants_of(self, seeds: set[str]) -> Iterator[tuple[str, dict[str, int]]]:
        """The same for some nodes, each by widening rings."""
        for n in sorted(seeds):
            own, ring, steps = {}, [n], 0
            while ring:
                steps += 1
                nxt = []
                for x in ring:
                    for c in self.down.get(x, ()):
                        if c not in own:
                            own[c] = steps
                            nxt.append(c)
                ring = nxt
            yield n, own

    # rows for the outputs

    def root_rows(self) -> Iterator[tuple]:
        for some in self.depths():
            for n, roots in some.items():
                if self.up.get(n):  # a root's own row does not come from links
                    for root, (d, _) in roots.items():
                        yield n, root, d
        loops = self.loops()
        for n in loops:
            yield n, LOOP, -1
        for n in self.below(loops):
            yield n, BELOW_LOOP, -1

    def node_rows(self) -> Iterator[tuple]:
        loops = self.loops()
        below = self.below(loops)
        best: dict[str, tuple[int, str]] = {}
        n_roots: dict[str, int] = defaultdict(int)
        for some in self.depths():
            for n, roots in some.items():
                n_roots[n] += len(roots)
                for root, (d, _) in roots.items():
                    if n not in best or (d, root) < best[n]:
                        best[n] = (d, root)
        n_down = {n: len(own) for n, own in self.descendants()}
        flags = lambda n: (n_down.get(n, 0), n in loops, n in below)
        of_root: dict[str, list[str]] = defaultdict(list)
        for n, (_, root) in best.items():
            of_root[root].append(n)
        for some in self.depths():  # again, for the paths from the nearest roots
            for root in [r for r in of_root if r in some and r in some[r]]:
                for n in of_root[root]:
                    path, at = [n], n
                    while at != root:
                        at = some[at][root][1]
                        path.append(at)
                    down, loop, under = flags(n)
                    yield n, self.level.get(n), root, best[n][0], path[::-1], n_roots[n], down, loop, under
        for n in self.nodes - best.keys():
            down, loop, under = flags(n)
            yield n, self.level.get(n), None, None, None, 0, down, loop, under

    def descendant_rows(self) -> Iterator[tuple]:
        for n, own in self.descendants():
            for d, s in own.items():
                yield n, d, s


_SCHEMAS = {
    "root": "id string, root_id string, depth int",
    "node": "id string, peel_level int, root_id string, depth int, path array<string>, n_roots int, n_descendants bigint, in_loop boolean, below_loop boolean",
    "descendant": "id string, descendant string, steps int",
}


def _in_tasks(links: DataFrame, what: str, seeded: bool = False) -> DataFrame:
    """Peels components task by task: each partition is ordered by component, and whole components are peeled as they come."""
    columns = [c.split()[0] for c in _SCHEMAS[what].split(", ")]

    def peel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solved(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            all_links = pd.concat(parts) if len(parts) > 1 else parts[0]
            rows: list[tuple] = []
            size = 0
            held = Peeled(all_links["child"].tolist(), all_links["parent"].tolist())
            if seeded:
                made = ((n, d, k) for n, own in held.descendants_of(set(all_links["parent"][all_links["seed"]])) for d, k in own.items())
            else:
                made = getattr(held, f"{what}_rows")()
            for row in made:
                rows.append(row)
                size += 1 + (len(row[4] or ()) if what == "node" else 0)  # paths count with their length
                if size >= 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch["component"].iloc[-1]
            tail = (batch["component"] == last).to_numpy()
            if tail.all():
                if held and held[-1]["component"].iloc[-1] != last:
                    yield from solved(held)
                    held = []
                held.append(batch)
            else:
                yield from solved([*held, batch[~tail]])
                held = [batch[tail]]
        if held:
            yield from solved(held)

    ordered = links.repartition("component").sortWithinPartitions("component").select("component", "child", "parent", *(["seed"] if seeded else []))
    return ordered.mapInPandas(peel, _SCHEMAS[what])


class Hierarchy:
    """Hierarchies of parent-child rows.

    rows has an id column and a column with the array of its parents (or one parent as a scalar column). Several rows of an id count
    with the union of their parents; null ids, null parents, and repeats are ignored; a parent need not have a row. Empty input gives empty outputs.
    Other columns are ignored, so clashing names do no harm.

    Leaves (nodes without children left) are peeled round by round and send their descendant lists to their parents; in reverse
    peel order depths, roots and paths go down again; what cannot be peeled has a loop below it. A connected component of at most
    `task_links` links is peeled whole inside one task, for groups of its roots one after another; a larger one by joins with a written table per round, so no task holds more
    than that. Both ways give the same rows: of ways to a root the shortest counts, and of those of one length that over the smallest parent.
    """

    def __init__(self, rows: DataFrame, id_col: str, parents_col: str, task_links: int = TASK_LINKS):
        self.spark = rows.sparkSession
        self.scratch = Scratch(self.spark, "hierarchy")
        parents = F.col(parents_col)
        is_array = dict(rows.dtypes)[parents_col].startswith("array")
        named = rows.filter(F.col(id_col).isNotNull())
        self.ids = named.select(F.col(id_col).cast("string").alias("id")).distinct()
        each = named.select(F.col(id_col).cast("string").alias("child"), (F.explode(parents.cast("array<string>")) if is_array else parents.cast("string")).alias("parent"))
        self.links = self.scratch.cut(each.filter(F.col("parent").isNotNull()).distinct())
        parts = connected_components(self.links, "child", "parent")
        # a component that is a single node with a link to itself has no edge, and is its own component
        tied = self.links.join(parts.withColumnRenamed("id", "child"), "child", "left").withColumn("component", F.coalesce("component", "child"))
        tied = self.scratch.cut(tied)
        big = self.scratch.cut(tied.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > task_links).select("component"))
        self.any_big = not big.isEmpty()
        self.small = tied.join(big, "component", "left_anti") if self.any_big else tied
        self.large = self.scratch.cut(tied.join(big, "component", "left_semi").select("child", "parent")) if self.any_big else None
        self._levels: DataFrame | None = None

    def _lone(self) -> DataFrame:
        """Ids without a parent: roots with a row."""
        return self.ids.join(self.links.select(F.col("child").alias("id")), "id", "left_anti")

    def roots(self) -> DataFrame:
        """(id, root_id, depth): the fewest steps from each id with a row to each root it reaches; ids in a loop have (id, '(loop)', -1), others below one (id, '(below loop)', -1)."""
        out = _in_tasks(self.small, "root").unionByName(self._lone().select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth")))
        if self.any_big:
            marks = self._marks()
            out = out.unionByName(self._depths().select("id", "root_id", "depth").filter(F.col("depth") > 0))
            out = out.unionByName(marks.select("id", F.when(F.col("in_loop"), LOOP).otherwise(BELOW_LOOP).alias("root_id"), F.lit(-1).alias("depth")))
        return out

    def nodes(self) -> DataFrame:
        """One row per node, those named only as parents too: peel_level (null: a loop lies below or through it), nearest root (ties: smallest) with depth and path from it,
        n_roots, n_descendants, in_loop, below_loop. root_id, depth and path are null where no root is reached."""
        columns = [c.split()[0] for c in _SCHEMAS["node"].split(", ")]
        alone = self._lone().join(self.links.select(F.col("parent").alias("id")), "id", "left_anti")
        out = _in_tasks(self.small, "node").unionByName(
            alone.select("id", F.lit(0).alias("peel_level"), F.col("id").alias("root_id"), F.lit(0).alias("depth"), F.array("id").alias("path"), F.lit(1).alias("n_roots"), F.lit(0).cast("bigint").alias("n_descendants"), F.lit(False).alias("in_loop"), F.lit(False).alias("below_loop"))
        )
        if self.any_big:
            depths = self._depths()
            near = depths.groupBy("id").agg(F.min(F.struct("depth", "root_id", "path")).alias("m"), F.count(F.lit(1)).cast("int").alias("n_roots"))
            down = self._descendants_by_joins().groupBy("id").agg(F.count(F.lit(1)).alias("n_descendants"))
            marks = self._marks()
            every = self._peel().join(near, "id", "left").join(down, "id", "left").join(marks, "id", "left")
            out = out.unionByName(
                every.select("id", F.col("level").alias("peel_level"), F.col("m.root_id").alias("root_id"), F.col("m.depth").alias("depth"), F.col("m.path").alias("path"), F.coalesce("n_roots", F.lit(0)).alias("n_roots"), F.coalesce("n_descendants", F.lit(0)).cast("bigint").alias("n_descendants"), F.coalesce("in_loop", F.lit(False)).alias("in_loop"), F.coalesce(~F.col("in_loop"), F.lit(False)).alias("below_loop"))
            )
        return out.select(columns)

    def descendants(self) -> DataFrame:
        """(id, descendant, steps): every pair with the fewest steps between them; a node of a loop is its own descendant."""
        out = _in_tasks(self.small, "descendant")
        return out.unionByName(self._descendants_by_joins()) if self.any_big else out

    def descendants_of(self, seeds: DataFrame) -> DataFrame:
        """(id, descendant, steps) of the seeds (id) only, so the pairs are bounded by what lies below them."""
        wanted = seeds.select(F.col("id").cast("string").alias("parent")).filter("parent IS NOT NULL").distinct().withColumn("seed", F.lit(True))
        marked = self.small.join(wanted, "parent", "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
        out = _in_tasks(marked, "descendant", seeded=True)
        if self.any_big:
            first = self.large.join(wanted, "parent", "left_semi").select(F.col("parent").alias("id"), F.col("child").alias("descendant"), F.lit(1).alias("steps"))
            step = lambda ring: self.large.join(ring.withColumnRenamed("descendant", "parent"), "parent").groupBy("id", F.col("child").alias("descendant")).agg((F.min("steps") + 1).alias("steps"))
            out = out.unionByName(self._grow(f"seeded-{self.scratch._n}", first, step, cycles=True))
        return out

    # large components, by joins

    def _peel(self) -> DataFrame:
        """(id, level) of the large components; level null: not peeled."""
        if self._levels is not None:
            return self._levels
        links, cut = self.large, self.scratch.cut
        nodes = links.select(F.col("child").alias("id")).union(links.select("parent")).distinct()
        state = cut(nodes.join(links.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("left")), "id", "left").select("id", F.coalesce("left", F.lit(0)).alias("left"), F.lit(None).cast("int").alias("level")))
        at = 0
        while True:
            leaves = state.filter(F.col("level").isNull() & (F.col("left") == 0)).select(F.col("id").alias("child"))
            if leaves.isEmpty():
                break
            sent = links.join(leaves, "child").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("sent"))
            nxt = cut(state.join(sent, "id", "left").select("id", (F.col("left") - F.coalesce("sent", F.lit(0))).alias("left"), F.when(F.col("level").isNull() & (F.col("left") == 0), F.lit(at)).otherwise(F.col("level")).alias("level")))
            self.scratch.drop(state)
            state, at = nxt, at + 1
        self._levels, self._height = state.select("id", "level"), at
        return self._levels

    def _grow(self, name: str, first: DataFrame, step, cycles: bool) -> DataFrame:
        """Rings of new rows, each ring a written part of one table, until a ring is empty."""
        path = f"{self.scratch.base}/{name}"
        schema = first.schema
        keys = [c for c in first.columns if c in ("id", "root_id", "descendant")]
        first.write.parquet(f"{path}/ring=0")
        k = 0
        while True:
            ring = self.spark.read.schema(schema).parquet(f"{path}/ring={k}")
            if ring.isEmpty():
                break
            new = step(ring)
            if cycles:
                seen = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path).select(keys)
                new = new.join(seen, keys, "left_anti")
            k += 1
            new.write.parquet(f"{path}/ring={k}")
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)

    def _depths(self) -> DataFrame:
        """(id, root_id, depth, path) of the large components: the residual by rings, then level by level in reverse peel order."""
        if getattr(self, "_depth_rows", None) is not None:
            return self._depth_rows
        levels, links = self._peel(), self.large
        top = levels.join(links.select(F.col("child").alias("id")), "id", "left_anti")
        leveled = self.scratch.cut(links.join(levels.withColumnRenamed("id", "child"), "child"), partition_by=None)
        start = top.select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"), F.array("id").alias("path"))
        within = leveled.filter(F.col("level").isNull()).select("child", "parent")

        def down(edges: DataFrame, got: DataFrame) -> DataFrame:
            reached = edges.join(got.withColumnRenamed("id", "parent"), "parent").select(F.col("child").alias("id"), "root_id", (F.col("depth") + 1).alias("depth"), "parent", F.concat("path", F.array("child")).alias("path"))
            # of ways of the same length that over the smallest parent, as in a task
            return reached.groupBy("id", "root_id").agg(F.min(F.struct("depth", "parent", "path")).alias("m")).select("id", "root_id", "m.depth", "m.path")

        rings = self._grow("depths", start, lambda ring: down(within, ring), cycles=True)
        base, schema = f"{self.scratch.base}/levels", rings.schema
        rings.write.parquet(f"{base}/top")
        for level in range(self._height - 1, -1, -1):
            got = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(base)
            down(leveled.filter(F.col("level") == level), got).write.parquet(f"{base}/level={level}")
        self._depth_rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(base)
        return self._depth_rows

    def _marks(self) -> DataFrame:
        """(id, in_loop) of the nodes of large components that lie in or below a loop."""
        levels, cut = self._peel(), self.scratch.cut
        core = levels.filter(F.col("level").isNull()).select("id")
        both = lambda part: self.large.join(part.withColumnRenamed("id", "child"), "child", "left_semi").join(part.withColumnRenamed("id", "parent"), "parent", "left_semi")
        found = cut(core.filter(F.lit(False)))
        links = cut(both(core))
        while not links.isEmpty():
            # peel from above and below: nodes without a link in or out of what is left are in no loop
            while True:
                inner = links.select(F.col("child").alias("id")).intersect(links.select(F.col("parent").alias("id")))
                nxt = cut(links.join(inner.withColumnRenamed("id", "child"), "child", "left_semi").join(inner.withColumnRenamed("id", "parent"), "parent", "left_semi"))
                done = nxt.count() == links.count()
                links = nxt
                if done:
                    break
            if links.isEmpty():
                break
            # colour: the smallest id that reaches a node from below; a colour's own node and what it reaches within the colour is one loop
            colour = cut(links.select(F.col("child").alias("id")).distinct().withColumn("colour", F.col("id")))
            while True:
                up = links.join(colour.withColumnRenamed("id", "child"), "child").groupBy(F.col("parent").alias("id")).agg(F.min("colour").alias("c"))
                nxt = cut(colour.join(up, "id", "left").select("id", F.least("colour", "c").alias("colour"), (F.col("c") < F.col("colour")).alias("moved")))
                moved = not nxt.filter("moved").isEmpty()
                self.scratch.drop(colour)
                colour = nxt.drop("moved") if moved else nxt.select("id", "colour")
                if not moved:
                    break
                colour = cut(colour)
            seeds = colour.filter(F.col("id") == F.col("colour")).select("id")
            inside = links.join(colour.withColumnRenamed("id", "child").withColumnRenamed("colour", "a"), "child").join(colour.withColumnRenamed("id", "parent").withColumnRenamed("colour", "b"), "parent").filter(F.col("a") == F.col("b"))
            inside = cut(inside.select("child", "parent"))
            loop = self._grow(f"loop-{self.scratch._n}", seeds, lambda ring: inside.join(ring.withColumnRenamed("id", "parent"), "parent").select(F.col("child").alias("id")).distinct(), cycles=True)
            selfish = inside.filter(F.col("child") == F.col("parent")).select(F.col("child").alias("id"))
            ends = loop.join(inside.join(loop.withColumnRenamed("id", "parent"), "parent", "left_semi").select(F.col("child").alias("id")), "id", "left_semi")
            found = cut(found.union(ends).union(selfish).distinct())
            links = cut(links.join(loop.withColumnRenamed("id", "child"), "child", "left_anti").join(loop.withColumnRenamed("id", "parent"), "parent", "left_anti"))
        below = self._grow(f"below-{self.scratch._n}", found, lambda ring: self.large.join(ring.withColumnRenamed("id", "parent"), "parent").select(F.col("child").alias("id")).distinct(), cycles=True)
        return self.scratch.cut(below.join(found.withColumn("in_loop", F.lit(True)), "id", "left").select("id", F.coalesce("in_loop", F.lit(False)).alias("in_loop")))

    def _descendants_by_joins(self) -> DataFrame:
        """(id, descendant, steps) of large components: peeled levels send their lists up, the residual grows by rings."""
        levels, links = self._peel(), self.large
        leveled = self.scratch.cut(links.join(levels.withColumnRenamed("id", "parent"), "parent"))
        base, schema = f"{self.scratch.base}/lists-{self.scratch._n}", "id string, descendant string, steps int"
        self.spark.createDataFrame([], schema).write.parquet(f"{base}/none")
        read = lambda: self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(base)
        for level in range(1, self._height):
            here = leveled.filter(F.col("level") == level).select("parent", "child")
            sent = here.join(read().withColumnRenamed("id", "child"), "child").select(F.col("parent").alias("id"), "descendant", (F.col("steps") + 1).alias("steps"))
            own = here.select(F.col("parent").alias("id"), F.col("child").alias("descendant"), F.lit(1).alias("steps"))
            own.union(sent).groupBy("id", "descendant").agg(F.min("steps").alias("steps")).write.parquet(f"{base}/level={level}")
        rest = leveled.filter(F.col("level").isNull())
        first = rest.select(F.col("parent").alias("id"), F.col("child").alias("descendant"), F.lit(1).alias("steps"))
        grown = self._grow(f"rest-{self.scratch._n}", first, lambda ring: links.join(ring.withColumnRenamed("descendant", "parent"), "parent").groupBy("id", F.col("child").alias("descendant")).agg((F.min("steps") + 1).alias("steps")), cycles=True)
        return read().unionByName(grown)
