"""Changes on their way: outcomes of arrivals, contexts, coalesced deltas, manifests, conflicts, membership changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import numbered, prefix


def outcomes(arrivals: DataFrame, at: str) -> DataFrame:
    """arrivals(replica, ctr, at) with `outcome`: delivered at once, delivered later, waiting for a lost one, or duplicate.

    A dot is delivered when all its replica's dots up to it have arrived: at the running maximum of first arrivals over the
    counters, as long as no counter is missing.
    """
    first = arrivals.groupBy("replica", "ctr").agg(F.min(at).alias("__first"))
    placed = numbered(first, ["replica"], "ctr", "__place")
    due = prefix(placed, ["replica"], "ctr", tops={"__due": F.col("__first")})
    known = due.select(F.col("replica").alias("__r"), F.col("ctr").alias("__c"), "__first", "__place", "__due")
    joined = arrivals.join(known, (F.col("replica") == F.col("__r")) & (F.col("ctr") == F.col("__c")))
    outcome = F.when(F.col(at) > F.col("__first"), "duplicate").when(F.col("__place") != F.col("ctr"), "waiting").when(F.col("__due") > F.col("__first"), "later").otherwise("delivered")
    return joined.withColumn("outcome", outcome).drop("__r", "__c", "__first", "__place", "__due")


def coalesced(deltas: DataFrame, order: str, keys: list[str], value: str) -> DataFrame:
    """Each unbroken run of deltas for one key, in order, as one delta with the greatest value: (keys, first, last, value)."""
    w = Window.partitionBy("__stream").orderBy(order)
    stream = deltas.withColumn("__stream", F.col("stream"))
    change = F.coalesce(F.lag(F.struct(*keys)).over(w) != F.struct(*keys), F.lit(True)).cast("int")
    runs = prefix(stream.withColumn("__c", change), ["__stream"], order, {"__run": F.col("__c")})
    return runs.groupBy("stream", "__run", *keys).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.max(value).alias(value)).drop("__run")


def manifest_problems(manifests: DataFrame) -> DataFrame:
    """(a, b, type, problem) for replicas a < b of manifests(replica, type, version): a type only one of them speaks, or in
    another version. Two replicas may exchange frames only of types without a problem."""
    mine = manifests.select(F.col("replica").alias("a"), "type", F.col("version").alias("va"))
    theirs = manifests.select(F.col("replica").alias("b"), "type", F.col("version").alias("vb"))
    everyone = manifests.select("replica").distinct()
    pairs = everyone.select(F.col("replica").alias("a")).join(everyone.select(F.col("replica").alias("b")), F.col("a") < F.col("b"))
    left = pairs.join(mine, "a").join(theirs, ["b", "type"], "left")
    right = pairs.join(theirs, "b").join(mine, ["a", "type"], "left_anti").select("a", "b", "type", F.lit("only b").alias("problem"))
    found = left.select("a", "b", "type", F.when(F.col("vb").isNull(), "only a").when(F.col("va") != F.col("vb"), "version").alias("problem"))
    return found.where("problem is not null").unionByName(right)


def conflicts(rows: DataFrame, identity: list[str], content: list[Column]) -> DataFrame:
    """Identities that arrived with more than one content, and with how many rows: merging must fail on them."""
    body = F.struct(*content)
    return rows.groupBy(*identity).agg(F.min(body).alias("__a"), F.max(body).alias("__b"), F.count("*").alias("n")).where("__a <> __b").drop("__a", "__b")


def transitions(views: DataFrame, group: str, order: str) -> DataFrame:
    """views(group, order, epoch, hash, prev) with `change`, held against the greatest epoch seen before: first, advance,
    same, conflict (another view of that epoch), rollback, gap, or forged (it names another predecessor)."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(F.struct("epoch", F.struct(F.lit(0) - F.col(order)).alias("o"), "hash")).over(w)
    held = views.withColumn("__top", top)
    epoch, hashed = F.col("__top.epoch"), F.col("__top.hash")
    change = (
        F.when(F.col("__top").isNull(), "first").when(F.col("epoch") < epoch, "rollback").when((F.col("epoch") == epoch) & (F.col("hash") == hashed), "same").when(F.col("epoch") == epoch, "conflict")
        .when(F.col("epoch") > epoch + 1, "gap").when(F.col("prev").eqNullSafe(hashed), "advance").otherwise("forged")
    )
    return held.withColumn("change", change).drop("__top")


def rejected_acks(acks: DataFrame, members: DataFrame, tags: DataFrame) -> DataFrame:
    """acks(epoch, member, tag) that don't count, with the reason: another epoch, no member of it, or an unknown tag."""
    newest = members.agg(F.max("epoch").alias("__newest"))
    current = members.join(newest, F.col("epoch") == F.col("__newest")).select(F.col("member").alias("__m")).distinct()
    known = tags.select(F.col("tag").alias("__t")).distinct()
    held = acks.join(newest, F.lit(True)).join(current, F.col("member") == F.col("__m"), "left").join(known, F.col("tag") == F.col("__t"), "left")
    reason = F.when(F.col("epoch") != F.col("__newest"), "epoch").when(F.col("__m").isNull(), "member").when(F.col("__t").isNull(), "tag")
    return held.select("epoch", "member", "tag", reason.alias("reason")).where("reason is not null")


def reconciled(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(key, action) between inventories(key, digest): fetch what only the other side has; what only this side has or what
    differs is an error of an append-only log."""
    a, b = local.select("key", F.col("digest").alias("a")), remote.select("key", F.col("digest").alias("b"))
    action = F.when(F.col("a").isNull(), "fetch").when(F.col("b").isNull(), "error: local only").when(F.col("a") != F.col("b"), "error: different")
    return a.join(b, "key", "full_outer").select("key", action.alias("action")).where("action is not null")


def fetched(log: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted rows of a log; if one is missing, an error and never a part."""
    lost = wanted.join(log.select(*keys), keys, "left_anti").agg(F.count("*").alias("__lost"))
    whole = F.assert_true(F.col("__lost") == 0, F.lit("wanted events are missing"))
    return log.join(wanted.select(*keys).distinct(), keys, "left_semi").join(lost, F.lit(True)).withColumn("__ok", whole).where("__ok is null").drop("__ok", "__lost")


def dependencies(writes: DataFrame, every: int) -> DataFrame:
    """writes(replica, op, ctr) with `context`, the counters of other replicas that the writer had seen: those of all rounds
    of `every` operations before its own; as text in order of replicas."""
    rounds = writes.groupBy(F.floor(F.col("op") / every).alias("round"), "replica").agg(F.max("ctr").alias("top"))
    seen = prefix(rounds, ["replica"], "round", tops={"upto": F.col("top")})
    numbers = writes.select(F.floor(F.col("op") / every).alias("of")).distinct()
    # Each round's last known counter of each replica: rounds are few beside operations.
    known = numbers.join(seen, F.col("round") < F.col("of")).groupBy("of", F.col("replica").alias("other")).agg(F.max("upto").alias("upto"))
    entry = F.concat("other", F.lit(":"), F.col("upto").cast("string"))
    listed = known.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("other", entry.alias("text")))).alias("entries"))
    joined = writes.withColumn("__round", F.floor(F.col("op") / every)).join(listed, F.col("__round") == F.col("of"), "left")
    own = F.filter("entries", lambda e: e["other"] != F.col("replica"))
    return joined.withColumn("context", F.coalesce(F.array_join(F.transform(own, lambda e: e["text"]), ","), F.lit(""))).drop("entries", "of", "__round")
