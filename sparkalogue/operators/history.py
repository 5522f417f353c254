"""Histories and graphs: reachability, tree diffs, change logs, blame, activity."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut in the folder that the cluster shares; a local one where none is set and the master is local (tests)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        import tempfile

        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sparkalogue-"))
    return df.checkpoint()


def ancestors(edges: DataFrame, starts: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(start, id): all ids reachable over (child, parent) edges of an acyclic graph, the start included.

    Round k joins what is reached with the paths of 2**k edges, which are those of the round before
    joined with themselves, so the number of rounds is logarithmic in the longest path. What a round
    finds is written once; only ids at which no path of that length begins are passed over.
    """
    from .stored import stored

    jumps = stored(edges.select(F.col("child").alias("a"), F.col("parent").alias("b")).where("a is not null and b is not null").distinct(), "jumps")
    reached = stored(starts.select(F.col("id").alias("start"), "id").where("id is not null").distinct(), "reached")
    for _ in range(max_rounds):
        if jumps.isEmpty():
            return reached
        further = reached.join(jumps, reached["id"] == jumps["a"]).select("start", F.col("b").alias("id")).distinct()
        new = stored(further.join(reached, ["start", "id"], "left_anti"), "reached")
        reached = reached.union(new)
        second = jumps.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jumps = stored(jumps.join(second, "b").select("a", F.col("c").alias("b")).distinct(), "jumps")
    raise RuntimeError("the graph has a cycle, or paths of over 2**max_rounds edges")


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, type, change) between two flat trees (path, type, oid): add, modify, delete; a type swap is delete and add."""
    o, n = (t.select("path", "type", F.col("oid").alias(k)) for t, k in ((old, "o"), (new, "n")))
    both = o.join(n, ["path", "type"], "full")
    change = F.when(F.col("o").isNull(), "add").when(F.col("n").isNull(), "delete").when(F.col("o") != F.col("n"), "modify")
    return both.withColumn("change", change).where("change is not null").select("path", "type", "change")


def change_log(versions: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Versions whose value differs from the one before (null counts as a value)."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(value).over(w)
    first = F.row_number().over(w) == 1
    return versions.withColumn("_new", first | ~F.col(value).eqNullSafe(before)).where("_new").drop("_new")


def islands(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbours: (key, run, value, n)."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    runs = df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run", value).agg(F.count("*").alias("n"))


def deltas(revisions: DataFrame, key: str, order: str, size: Column) -> DataFrame:
    """Revisions with their size and the change against the one before (all of it for the first)."""
    sized = revisions.withColumn("size", size)
    before = F.coalesce(F.lag("size").over(Window.partitionBy(key).orderBy(order)), F.lit(0))
    return sized.withColumn("delta", F.col("size") - before)


def parent_deltas(revisions: DataFrame, rev: str, parent: str, size: Column) -> DataFrame:
    """Revisions with their size and the change against their parent's, wherever that stands; all of it without a known parent."""
    sized = revisions.withColumn("size", size)
    before = sized.select(F.col(rev).alias(parent), F.col("size").alias("_before"))
    return sized.join(before, parent, "left").withColumn("delta", F.col("size") - F.coalesce("_before", F.lit(0))).drop("_before")


def local_day(epoch_seconds: Column, tz_minutes: Column) -> Column:
    """Day in the author's zone; minutes west of UTC as JavaScript counts them."""
    return F.to_date(F.timestamp_seconds(epoch_seconds - tz_minutes * 60))


def nearest_rank(counts: Column, p: float) -> Column:
    """Entry floor(p (n - 1)) of an ascending array; null for an empty one."""
    return F.get(counts, F.floor(p * (F.size(counts) - 1)).cast("int"))


def quartile_levels(days: DataFrame, key: str, count: str) -> DataFrame:
    """Activity level 0-4 of each day by the nearest-rank quartiles of the key's nonzero days.

    Quartiles come from a histogram of counts, so a key of many days costs its distinct counts.
    """
    counted = days.where(F.col(count) > 0).groupBy(key, F.col(count).alias("_c")).agg(F.count("*").alias("_m"))
    w = Window.partitionBy(key).orderBy("_c")
    ranked = counted.withColumn("_upto", F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_m").over(Window.partitionBy(key)))
    at = lambda p: F.min(F.when(F.col("_upto") > F.floor(p * (F.col("_all") - 1)), F.col("_c")))
    cuts = ranked.groupBy(key).agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    level = F.when(F.col(count) <= 0, 0).when(F.col(count) <= F.col("q1"), 1).when(F.col(count) <= F.col("q2"), 2).when(F.col(count) <= F.col("q3"), 3).otherwise(4)
    return days.join(cuts, key, "left").withColumn("level", level)


def blame_lines(versions: list[str]) -> list[int]:
    """Version number that each line of the last version came with."""
    lines: list[str] = []
    owner: list[int] = []
    for k, text in enumerate(versions):
        new = text.split("\n")
        kept: list[int] = [k] * len(new)
        for op, a, b, c, _ in difflib.SequenceMatcher(None, lines, new, autojunk=False).get_opcodes():
            if op == "equal":
                kept[c : c + b - a] = owner[a:b]
        lines, owner = new, kept
    return owner


def hunks(owner: list[int]) -> list[tuple[int, int, int]]:
    """(version, first line, lines) of the runs of equal owners."""
    out: list[tuple[int, int, int]] = []
    for i, v in enumerate(owner):
        if out and out[-1][0] == v:
            out[-1] = (v, out[-1][1], out[-1][2] + 1)
        else:
            out.append((v, i, 1))
    return out


def _line_sources(old: str | None, new: str) -> list[int]:
    """For each line of the new text the line of the old one that it is, or -1; without an old text all are new."""
    lines = new.split("\n")
    out = [-1] * len(lines)
    if old is not None:
        for op, a, b, c, _ in difflib.SequenceMatcher(None, old.split("\n"), lines, autojunk=False).get_opcodes():
            if op == "equal":
                out[c : c + b - a] = range(a, b)
    return out


def blame(versions: DataFrame, key: str, order: str, text: str, max_rounds: int = 40) -> DataFrame:
    """(key, version, first_line, n_lines): hunks of each key's last version; versions count from 0 in `order`, which is unique within a key.

    Neighbouring versions are compared a pair a row, wherever their key lies. Each line then points at the
    same line one version before, or at itself where it is new, and pointers are doubled until all
    point at the version a line came with: a logarithmic number of joins, and no key is one group.
    """

    @F.pandas_udf("array<int>")
    def sources(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([_line_sources(a, b or "") for a, b in zip(old, new, strict=True)])

    named = versions.select(F.col(key).cast("long").alias("k"), F.col(order).cast("long").alias("o"), F.coalesce(text, F.lit("")).alias("t"))
    places = named.select("k", "o").withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o")) - 1)
    numbered = checkpointed(named.join(places, ["k", "o"]).select("k", "n", "t"))
    before = numbered.select("k", (F.col("n") + 1).alias("n"), F.col("t").alias("old"))
    each = numbered.join(before, ["k", "n"], "left").select("k", "n", F.posexplode(sources("old", "t")).alias("line", "source"))
    kept = F.col("source") >= 0
    at = checkpointed(each.select("k", "n", "line", F.when(kept, F.col("n") - 1).otherwise(F.col("n")).alias("to_n"), F.when(kept, F.col("source")).otherwise(F.col("line")).alias("to_line")))
    for _ in range(max_rounds):
        further = at.select("k", F.col("n").alias("to_n"), F.col("line").alias("to_line"), F.col("to_n").alias("far_n"), F.col("to_line").alias("far_line"))
        stepped = checkpointed(at.join(further, ["k", "to_n", "to_line"]).select("k", "n", "line", F.col("far_n").alias("to_n"), F.col("far_line").alias("to_line"), (F.col("far_n") != F.col("to_n")).alias("moved")))
        at = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("a key has too many versions")
    last = at.join(numbered.groupBy("k").agg(F.max("n").alias("n")), ["k", "n"]).select("k", "line", F.col("to_n").cast("long").alias("version"))
    by_line = Window.partitionBy("k").orderBy("line")
    begins = last.withColumn("new", F.coalesce((F.lag("version").over(by_line) != F.col("version")).cast("int"), F.lit(1)))
    runs = begins.withColumn("run", F.sum("new").over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy("k", "run", "version").agg(F.min("line").cast("long").alias("first_line"), F.count("*").alias("n_lines"))
    return found.select(F.col("k").alias(key), "version", "first_line", "n_lines")


def line_changes(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """pairs with added and removed: lines that differ between two texts."""

    @F.pandas_udf("struct<added: long, removed: long>")
    def count(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            ops = difflib.SequenceMatcher(None, (x or "").split("\n"), (y or "").split("\n"), autojunk=False).get_opcodes()
            rows.append((sum(d - c for op, _, _, c, d in ops if op != "equal"), sum(q - p for op, p, q, _, _ in ops if op != "equal")))
        return pd.DataFrame(rows, columns=["added", "removed"])

    return pairs.withColumn("_d", count(F.col(old), F.col(new))).select("*", "_d.added", "_d.removed").drop("_d")


def subtree_totals(files: DataFrame, path: str, size: str) -> DataFrame:
    """(dir, file_count, total_size) of every directory, its subdirectories included."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return files.withColumn("_n", F.size(parts)).where("_n > 0").select(F.explode(dirs).alias("dir"), F.col(size).alias("_s")).groupBy("dir").agg(F.count("*").alias("file_count"), F.sum("_s").alias("total_size"))


def resolve_revision(commits: DataFrame, refs: dict[str, str], rev: str) -> str | None:
    """Commit of a ref name or of a unique hex prefix of 4 digits or more."""
    if rev in refs:
        return refs[rev]
    if len(rev) < 4:
        return None
    found = commits.where(F.col("oid").startswith(rev.lower())).select("oid").distinct().limit(2).collect()
    return found[0]["oid"] if len(found) == 1 else None




def snapshot(entries: DataFrame, root: str, max_depth: int = 64) -> DataFrame:
    """(path, type, oid) of everything below a tree; entries (tree, name, type, oid).

    Each round expands the directories found in the last one; equal subtrees are joined once a place.
    """
    level = entries.where(F.col("tree") == root).select(F.col("name").alias("path"), "type", "oid")
    out = level
    for _ in range(max_depth):
        dirs = checkpointed(level.where("type = 'tree'").select(F.col("path").alias("parent"), F.col("oid").alias("tree")))
        if dirs.isEmpty():
            return out
        level = dirs.join(entries, "tree").select(F.concat_ws("/", "parent", "name").alias("path"), "type", "oid")
        out = out.union(level)
    raise RuntimeError("tree is deeper than max_depth")


def flatten_tree(roots: DataFrame, key: str, tree: str, max_depth: int = 64) -> DataFrame:
    """(key, path, name, type, size, date, md5, sha1, sha256) of every node of JSON trees of (name, type, size, date, hashes, children).

    `tree` is a JSON array of nodes; null and broken ones have none. Children stay JSON text until
    their level comes up, so trees of any depth are read a level at a time.
    """
    node = "array<struct<name: string, type: string, size: bigint, date: string, md5: string, sha1: string, sha256: string, children: string>>"
    level, out = roots.select(key, F.lit("").alias("above"), F.col(tree).alias("nodes")), None
    for _ in range(max_depth):
        found = level.select(key, "above", F.explode(F.from_json("nodes", node)).alias("n"))
        found = checkpointed(found.select(key, F.concat("above", F.lit("/"), "n.name").alias("path"), "n.*"))
        if found.isEmpty():
            return out if out is not None else found.drop("children")
        out = found.drop("children") if out is None else out.union(found.drop("children"))
        level = found.where("type = 'dir' and children is not null").select(key, F.col("path").alias("above"), F.col("children").alias("nodes"))
    raise RuntimeError("tree is deeper than max_depth")


def tree_files(nodes: DataFrame) -> DataFrame:
    """Nodes that are files: all but directories without a hash (an archive listed as a directory has one)."""
    return nodes.where("type != 'dir' or coalesce(md5, sha1, sha256) is not null")


def tree_dates(nodes: DataFrame, key: str) -> DataFrame:
    """(key, path, date) of the nodes with a date, the last one of equal paths left to the caller."""
    return nodes.where("date is not null and date != ''").select(key, "path", "date")


def fold_tree(files: DataFrame, key: str, path: str = "path") -> DataFrame:
    """(key, tree): the JSON array of nested nodes of flat rows (key, path, is_dir, date, size, md5, sha1, sha256).

    The inverse of flatten_tree: directories first, then files, each by name; directories that only
    occur within paths are made, and a file whose path is a directory too (an archive with its
    members) gives that directory its hashes, and its date and size where it has none. Of repeated
    rows the greatest counts, and nodes without a value for a field leave it out. A key without any
    path has no row.

    Rows are shuffled once, by key. A tree is one row, so its nodes are one group as well: in the
    order of the tree each of them closes what stands open below its parent, and opens itself.
    """
    parts = F.filter(F.split(F.coalesce(F.col(path), F.lit("")), "/"), lambda p: p != "")
    values = ["date", "size", "md5", "sha1", "sha256"]
    dealt = files.select(F.col(key).alias("k"), parts.alias("p"), F.coalesce("is_dir", F.lit(False)).alias("is_dir"), F.struct(*values).alias("v")).where("size(p) > 0").repartition("k")
    latest = dealt.groupBy("k", "p", "is_dir").agg(F.max("v").alias("v"))
    at = F.size("p")
    # a node itself, and the directories above it
    above = F.transform(F.sequence(F.lit(1), at), lambda n: F.struct(F.slice("p", F.lit(1), n).alias("p"), ((n < at) | F.col("is_dir")).alias("is_dir"), F.when((n == at) & F.col("is_dir"), F.col("v")).alias("d"), F.when((n == at) & ~F.col("is_dir"), F.col("v")).alias("f")))
    each = latest.select("k", F.explode(above).alias("n")).select("k", "n.*")
    nodes = each.groupBy("k", "p").agg(F.max("is_dir").alias("is_dir"), F.max("d").alias("d"), F.max("f").alias("f"))
    pick = [F.coalesce(f"d.{v}", f"f.{v}").alias(v) if v in ("date", "size") else F.col(f"f.{v}").alias(v) for v in values]
    head = F.to_json(F.struct(F.element_at("p", -1).alias("name"), F.when(F.col("is_dir"), "dir").otherwise("file").alias("type"), *pick))
    # a directory stands before what is in it, and before the files beside it
    place = F.transform("p", lambda name, i: F.struct(((i == at - 1) & ~F.col("is_dir")).alias("is_file"), name.alias("name")))
    opened = F.when(F.col("is_dir"), F.concat(F.expr("left(head, length(head) - 1)"), F.lit(',"children":['))).otherwise(F.col("head"))
    node = F.struct(place.alias("place"), opened.alias("opened"), (at + F.col("is_dir").cast("int")).alias("inside"), at.alias("depth"))
    trees = nodes.withColumn("head", head).select("k", node.alias("n")).groupBy("k").agg(F.sort_array(F.collect_list("n")).alias("n"))
    close = lambda times: F.repeat(F.lit("]}"), times)

    def text(n: Column, i: Column) -> Column:
        left = F.get(F.col("n.inside"), i - 1) - n["depth"]
        return F.concat(F.when((i == 0) | (left < 0), F.lit("")).otherwise(F.concat(close(left), F.when(F.get(F.col("n.depth"), i - 1) < n["depth"], F.lit("")).otherwise(F.lit(",")))), n["opened"])

    whole = F.concat(F.lit("["), F.array_join(F.transform("n", text), ""), close(F.element_at(F.col("n.inside"), -1) - 1), F.lit("]"))
    return trees.select(F.col("k").alias(key), whole.alias("tree"))


def revert_plan(revisions: DataFrame, author: str, since: Column, page: str = "page", order: str = "rev", live: DataFrame | None = None) -> DataFrame:
    """(page, bad_rev, good_rev, action): what undoing an author's edits takes, for pages whose newest revision is theirs.

    good_rev is the newest revision by anyone else; without one the page is to be deleted. With `live`
    (page), other pages are left out. Both are aggregates, so a page of any history costs a row a task.
    """
    if live is not None:
        revisions = revisions.join(live.select(page).distinct(), page, "left_semi")
    newest = revisions.groupBy(page).agg(F.max_by(F.struct(F.col(order), "author", since.alias("recent")), order).alias("last"), F.max(F.when(F.col("author") != author, F.col(order))).alias("good_rev"))
    bad = newest.where((F.col("last.author") == author) & F.col("last.recent"))
    return bad.select(page, F.col(f"last.{order}").alias("bad_rev"), "good_rev", F.when(F.col("good_rev").isNull(), "delete").otherwise("revert").alias("action"))


def apply_reverts(revisions: DataFrame, plan: DataFrame, by: str, page: str = "page", order: str = "rev") -> DataFrame:
    """revisions with what a plan adds: a revision after the bad one, by the given author, that repeats the good one; pages to delete add none."""
    good = plan.where("action = 'revert'").select(page, F.col("good_rev").alias(order), "bad_rev")
    again = revisions.join(good, [page, order]).withColumn(order, F.col("bad_rev") + 1).withColumn("author", F.lit(by))
    return revisions.unionByName(again.select(*[F.col(c).cast(revisions.schema[c].dataType).alias(c) for c in revisions.columns]))


def log_page(commits: DataFrame, reachable: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    """Commits that are reachable, in manifest order, one page."""
    return commits.join(reachable.select("id").distinct(), commits["oid"] == F.col("id"), "left_semi").orderBy(order).offset(offset).limit(limit)


def year_grid(years: DataFrame) -> DataFrame:
    """(year, day, week, dow) of all days; weeks begin on Sunday and count from the year's first."""
    first = F.make_date("year", F.lit(1), F.lit(1))
    days = years.select("year", F.explode(F.sequence(first, F.make_date("year", F.lit(12), F.lit(31)))).alias("day"))
    dow = F.dayofweek("day") - 1
    shift = F.dayofweek(F.make_date("year", F.lit(1), F.lit(1))) - 1
    week = F.floor((F.dayofyear("day") - 1 + shift) / 7)
    return days.select("year", "day", week.cast("int").alias("week"), dow.cast("int").alias("dow"))
