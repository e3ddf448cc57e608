"""The registered queries and, for each, the SQL that gives the same rows.

Each query derives its input log from the tables as its SQL does, and applies one operator of the library to all of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tags import tag
from ..operators import clocks, counters, delivery, documents, gc, merkle, presence, registers, sequences, sets, snapshots, trees
from ..sources import frames, log
from ..sources.oplog import delivered, lossy, ops, table
from ..streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

OPS = """
ops as (
  select event_id op, 'r' || (user_id % 5)::varchar replica, event_type obj, user_id elem, round(value * 100)::bigint amt,
    epoch_us(ts) // 1000 ms, row_number() over (partition by user_id % 5 order by event_id) ctr
  from events),
deliveries as (select * from ops union all select * from ops where op % 3 = 0),
lossy as (select * from deliveries where op % 17 <> 0)"""


def query(sql: str | None = None, with_ops: bool = True):
    """Register a query under its function's name, with its SQL; `ops`, `deliveries` and `lossy` stand before it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            text = sql.strip()
            if with_ops:
                first = next((w for w in ("with recursive ", "with ") if text.startswith(w)), "")
                text = f"{first or 'with '}{OPS}{', ' if first else ' '}{text[len(first):]}"
            ORACLES[f.__name__] = text
        return f

    return register


def long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


RUNNING = "with r as (select obj, replica, op, sum(amt) over (partition by obj, replica order by op) component from ops)"


def running(spark, sf_dir) -> DataFrame:
    return counters.deltas(ops(spark, sf_dir), "obj", "amt")


# Counters


@query(f"{RUNNING}, d as (select * from r union all select * from r where op % 3 = 0) select obj, replica, max(component)::bigint component from d group by all")
def gcounter_components(spark, sf_dir):
    return counters.merged(delivered(running(spark, sf_dir)))


@query(f"{RUNNING}, m as (select obj, replica, max(component) c from r group by all) select obj, sum(c)::bigint v from m group by obj")
def gcounter_value(spark, sf_dir):
    return counters.value(counters.merged(delivered(running(spark, sf_dir))))


@query(f"{RUNNING} select obj, replica, max(component)::bigint component, true agrees from r group by all")
def gcounter_partial_merge(spark, sf_dir):
    deltas = running(spark, sf_dir)
    half = [counters.merged(deltas.where(F.col("op") % 2 == k)) for k in (0, 1)]
    whole = counters.merged(deltas).withColumnRenamed("component", "whole")
    return counters.merged(half[0].unionByName(half[1])).join(whole, ["obj", "replica"]).select("obj", "replica", "component", (F.col("component") == F.col("whole")).alias("agrees"))


@query(f"""{RUNNING}, o as (select obj, replica, max(component) old from r where op % 17 <> 0 and op % 2 = 0 group by all)
select obj, replica, r.component::bigint component, coalesce(old, 0)::bigint old, r.component > coalesce(old, 0) changed
from (select obj, replica, max(component) component from r group by all) r left join o using (obj, replica)""")
def gcounter_changed(spark, sf_dir):
    deltas = running(spark, sf_dir)
    return counters.changed(counters.merged(lossy(deltas).where(F.col("op") % 2 == 0)), counters.merged(deltas))


@query("""with r as (select elem, replica, op, case obj when 'error' then -1 else 1 end sign, sum(amt) over (partition by elem, replica, obj order by op) c
  from ops where obj in ('purchase', 'error')), m as (select elem, replica, sign, max(c) c from r group by all)
select elem, sum(sign * c)::bigint v from m group by elem""")
def pncounter_value(spark, sf_dir):
    used = ops(spark, sf_dir).where(F.col("obj").isin("purchase", "error")).withColumn("sign", F.when(F.col("obj") == "error", -1).otherwise(1))
    deltas = counters.deltas(used.withColumn("key", F.struct("elem", "sign")), "key", "amt").select("obj.*", "replica", "op", "component")
    return counters.signed_value(delivered(deltas), "elem")


# Sets


@query("select distinct obj, elem from deliveries")
def gset_elements(spark, sf_dir):
    return delivered(ops(spark, sf_dir)).select("obj", "elem").distinct()


@query("select distinct obj, amt from ops where op % 2 = 0 except select obj, amt from ops where op % 2 = 1")
def gset_missing(spark, sf_dir):
    log_ = ops(spark, sf_dir)
    return sets.missing(log_.where("op % 2 = 0"), log_.where("op % 2 = 1"), ["obj", "amt"])


TOMBS = """with a as (select * from {log} where obj <> 'error'),
t as (select distinct a.op from a join {log} r on r.obj = 'error' and r.replica = a.replica and r.elem = a.elem and r.op > a.op)"""
BY_EVENT = "x as (select * replace ('r' || (op % 3)::varchar as replica) from ops)"


def removed(log_: DataFrame) -> tuple[DataFrame, DataFrame]:
    log_ = log_.select("op", "replica", "obj", "elem", "ms", "ctr")
    return log_.where("obj <> 'error'"), sets.tombstones(log_, F.col("obj") == "error")


@query(TOMBS.format(log="ops") + " select elem, count(*) live_tags from a left join t on a.op = t.op where t.op is null group by elem")
def orset_elements(spark, sf_dir):
    adds, tombs = removed(ops(spark, sf_dir))
    return sets.live(adds, tombs).groupBy("elem").agg(F.count("*").alias("live_tags"))


@query(TOMBS.format(log="ops") + " select op from t")
def orset_tombstones(spark, sf_dir):
    return removed(delivered(ops(spark, sf_dir)))[1].select("op").distinct()


@query(f"with {BY_EVENT}, {TOMBS.format(log='x')[5:]} select elem, count(*) live_tags from a left join t on a.op = t.op where t.op is null group by elem")
def orset_add_wins(spark, sf_dir):
    adds, tombs = removed(ops(spark, sf_dir).withColumn("replica", F.concat(F.lit("r"), (F.col("op") % 3).cast("string"))))
    return sets.live(adds, tombs).groupBy("elem").agg(F.count("*").alias("live_tags"))


@query(TOMBS.format(log="ops") + ", f as (select replica, max(op) upto from ops where op % 10 < 5 and ctr % 3 = 0 group by replica) select a.op, a.replica from a join t on a.op = t.op join f on f.replica = a.replica where a.op <= f.upto")
def orset_compact_frontier(spark, sf_dir):
    log_ = ops(spark, sf_dir)
    upto = log_.where("op % 10 < 5 and ctr % 3 = 0").groupBy("replica").agg(F.max("op").alias("upto"))
    return sets.compactable(removed(log_)[1], upto).select("op", "replica")


# Registers and maps


@query("select obj, arg_max(amt, (ms, ctr, replica)) v, max((ms, ctr, replica))[1] wall, max((ms, ctr, replica))[2] logical, max((ms, ctr, replica))[3] replica from deliveries group by obj")
def lww_register(spark, sf_dir):
    found = registers.latest(delivered(ops(spark, sf_dir)), ["obj"], ["amt"], tag("ms", "ctr", "replica"))
    return found.select("obj", F.col("amt").alias("v"), "tag.*")


@query("select obj, max(amt) v from deliveries group by obj")
def max_register(spark, sf_dir):
    return delivered(ops(spark, sf_dir)).groupBy("obj").agg(F.max("amt").alias("v"))


LATEST = "with m as (select elem, arg_max(amt, (ms, ctr, replica)) v, arg_max(obj, (ms, ctr, replica)) obj, max((ms, ctr, replica)) t from deliveries group by elem)"


def latest_by_elem(spark, sf_dir) -> DataFrame:
    return registers.latest(delivered(ops(spark, sf_dir)), ["elem"], ["amt", "obj"], tag("ms", "ctr", "replica")).withColumn("present", F.col("obj") != "error")


@query(LATEST + " select elem from m where obj <> 'error'")
def lww_set(spark, sf_dir):
    return latest_by_elem(spark, sf_dir).where("present").select("elem")


@query(LATEST + " select elem, v from m where obj <> 'error'")
def lww_map_visible(spark, sf_dir):
    return latest_by_elem(spark, sf_dir).where("present").select("elem", F.col("amt").alias("v"))


@query(LATEST + " select elem, v, obj <> 'error' present, t[1] wall, t[2] logical, t[3] replica from m")
def lww_map_state(spark, sf_dir):
    return latest_by_elem(spark, sf_dir).select("elem", F.col("amt").alias("v"), "present", "tag.*")


@query("select replica, ms // 3600000 wall, count(*) n from deliveries group by all having count(distinct (elem, amt)) > 1")
def tag_conflict_audit(spark, sf_dir):
    hourly = delivered(ops(spark, sf_dir)).withColumn("wall", F.floor(F.col("ms") / 3600000))
    return registers.tag_conflicts(hourly, ["replica", "wall"], ["elem", "amt"])


@query("""with own as (select obj, replica, max(ctr) ctr from ops group by all),
w as (select obj, replica writer, max(op) // 500 upto from ops group by all),
seen as (select o.obj, o.replica, max(o.ctr) seen from ops o join w on w.obj = o.obj and w.writer <> o.replica and o.op // 500 < w.upto group by all)
select o.obj, o.replica, o.ctr, p.amt v from own o left join seen s on s.obj = o.obj and s.replica = o.replica
join ops p on p.obj = o.obj and p.replica = o.replica and p.ctr = o.ctr where o.ctr > coalesce(seen, 0)""")
def mv_register_values(spark, sf_dir):
    writes = ops(spark, sf_dir)
    return registers.multi_value(writes, registers.contexts_at_rounds(writes, 500)).select("obj", "replica", "ctr", F.col("amt").alias("v"))


@query("select replica, max((ms, ctr))[1] wall, max((ms, ctr))[2] logical from lossy group by replica")
def observed_frontier(spark, sf_dir):
    return registers.observed_frontier(lossy(ops(spark, sf_dir)), tag("ms", "ctr", "replica")).select("replica", "tag.wall", "tag.logical")


@query("""with w as (select replica, ctr, max(ms // 3600000) over (partition by replica order by ctr) wall from ops)
select replica, ctr, wall, row_number() over (partition by replica, wall order by ctr) - 1 logical from w""")
def hlc_tags(spark, sf_dir):
    hours = ops(spark, sf_dir).withColumn("h", F.floor(F.col("ms") / 3600000))
    return registers.running_clock(hours, "replica", "ctr", "h").select("replica", "ctr", "wall", "logical")


HOURS = "h as (select replica, ctr, ms // 3600000 h, case when op % 4 = 0 then ms // 3600000 + op % 3 end sw, case when op % 4 = 0 then op % 7 end sl from ops)"


@query(f"""with {HOURS}, w as (select *, max(greatest(h, coalesce(sw, 0))) over (partition by replica order by ctr) wall from h),
l as (select *, greatest(case when row_number() over (partition by replica, wall order by ctr) = 1 then 0 end, case when sw = wall then sl + 1 end) - ctr lift from w)
select replica, ctr, wall, (max(lift) over (partition by replica, wall order by ctr) + ctr)::bigint logical from l""")
def hlc_witness(spark, sf_dir):
    hours = ops(spark, sf_dir).withColumn("h", F.floor(F.col("ms") / 3600000))
    heard = hours.withColumns({"wall": F.when(F.col("op") % 4 == 0, F.col("h") + F.col("op") % 3), "logical": F.when(F.col("op") % 4 == 0, F.col("op") % 7)})
    return clocks.witnessed(heard, "replica", "ctr", "h", "wall", "logical")


# Delivery and the log

RANKED = "with d as (select distinct replica, ctr from lossy), n as (select replica, ctr, row_number() over (partition by replica order by ctr) k from d)"


@query(RANKED + " select replica, coalesce(max(case when ctr = k then ctr end), 0)::bigint frontier, count(*) filter (ctr <> k) pending from n group by replica")
def inbox_frontier(spark, sf_dir):
    return delivery.frontier(lossy(ops(spark, sf_dir)))


@query(RANKED + " select replica, ctr from n where ctr <> k")
def inbox_pending(spark, sf_dir):
    return delivery.waiting(lossy(ops(spark, sf_dir)))


@query("select replica, ctr, count(*) - 1 extra from lossy group by all having count(*) > 1")
def inbox_duplicates(spark, sf_dir):
    return delivery.repeats(lossy(ops(spark, sf_dir)))


@query(RANKED + " select replica, min(ctr) \"first\", count(*) length from n group by replica, ctr - k")
def rga_run_blocks(spark, sf_dir):
    return delivery.runs(lossy(ops(spark, sf_dir)))


@query("select obj, replica, ctr, op, row_number() over (partition by obj order by op) seq, sha256(amt::varchar) digest from ops")
def log_append(spark, sf_dir):
    return log.appended(delivered(ops(spark, sf_dir)), "obj", "op", F.col("amt").cast("string")).select("obj", "replica", "ctr", "op", "seq", "digest")


@query("with a as (select replica, ctr, amt from deliveries union all select replica, ctr, amt + 1 from ops where op % 50 = 0) select replica, ctr, count(*) arrivals from a group by all having count(distinct amt) > 1")
def log_dot_conflicts(spark, sf_dir):
    log_ = ops(spark, sf_dir)
    altered = log_.where("op % 50 = 0").withColumn("amt", F.col("amt") + 1)
    return log.dot_conflicts(delivered(log_).unionAll(altered), F.col("amt"))


@query("with l as (select obj, replica, ctr, row_number() over (partition by obj order by op) seq from ops) select * from l where seq > 100")
def log_replay(spark, sf_dir):
    appended = log.appended(delivered(ops(spark, sf_dir)), "obj", "op", F.col("amt").cast("string"))
    return log.replay(appended, "obj", 100, 10**9).select("obj", "replica", "ctr", "seq")


@query("with v as (select replica, max(ctr) // 2 seen from ops group by replica) select o.replica, o.ctr, o.op from ops o join v on v.replica = o.replica where o.ctr > seen")
def log_catch_up(spark, sf_dir):
    log_ = ops(spark, sf_dir)
    vector = log_.groupBy("replica").agg(F.floor(F.max("ctr") / 2).alias("seen"))
    return log.catch_up(log_, vector).select("replica", "ctr", "op")


# Inventories, recovery, collection

LEAVES = """select o_custkey % 64 tree, lpad(o_orderkey::varchar, 12, '0') key, sha256(o_orderstatus || ':' || round(o_totalprice * 100)::bigint::varchar) digest from orders"""


def order_leaves(spark, sf_dir, changed: bool = False) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 64).alias("tree"), "o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    if changed:
        orders = orders.where("o_orderkey % 11 <> 0").withColumn("cents", F.when(F.col("o_orderkey") % 13 == 0, F.col("cents") + 1).otherwise(F.col("cents")))
    return merkle.leaves(orders, F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.concat_ws(":", "o_orderstatus", F.col("cents").cast("string")), "tree")


@query(f"with l as ({LEAVES}) select tree, key, digest, sha256(unhex('00') || unhex('0C') || encode(key) || unhex(digest)) leaf from l", with_ops=False)
def merkle_leaves(spark, sf_dir):
    return order_leaves(spark, sf_dir)


@query(f"""with a as ({LEAVES}),
b as (select lpad(o_orderkey::varchar, 12, '0') key, sha256(o_orderstatus || ':' || (round(o_totalprice * 100)::bigint + case when o_orderkey % 13 = 0 then 1 else 0 end)::varchar) digest from orders where o_orderkey % 11 <> 0)
select coalesce(a.key, b.key) key, case when b.key is null then 'left' when a.key is null then 'right' else 'different' end side from a full join b on a.key = b.key where a.digest is distinct from b.digest""", with_ops=False)
def merkle_diff(spark, sf_dir):
    return merkle.differences(order_leaves(spark, sf_dir), order_leaves(spark, sf_dir, changed=True))


@query(f"""with recursive l as ({LEAVES}), n as (select tree, list(sha256(unhex('00') || unhex('0C') || encode(key) || unhex(digest)) order by key) nodes from l group by tree),
r as (select tree, nodes from n union all select tree, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(unhex('01') || unhex(nodes[2 * i + 1]) || unhex(coalesce(nodes[2 * i + 2], repeat('00', 32))))) from r where len(nodes) > 1)
select tree, nodes[1] root from r where len(nodes) = 1""", with_ops=False)
def merkle_root(spark, sf_dir):
    return merkle.roots(order_leaves(spark, sf_dir), "tree")


@query(f"{RUNNING} select obj, replica, max(component)::bigint component from r group by all")
def snapshot_recovery(spark, sf_dir):
    deltas = running(spark, sf_dir)
    snapshot = counters.merged(deltas.where("op <= 5000"))
    return snapshots.recovered(snapshot, deltas.where("op > 4000"), counters.merged)


@query("select distinct obj, amt from ops except select obj, amt from ops where op <= 500")
def delta_since(spark, sf_dir):
    log_ = ops(spark, sf_dir)
    state = lambda rows: rows.select("obj", "amt").distinct()
    return snapshots.since(state(log_), state(log_.where("op <= 500")), ["obj", "amt"])


ACKS = "with m as (select distinct replica mem from ops), a as (select o.op tag, m.mem from ops o, m where (o.op + substr(m.mem, 2)::bigint) % 7 <> 0)"


def acknowledged(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    log_ = ops(spark, sf_dir)
    members = log_.select(F.lit(1).alias("epoch"), F.col("replica").alias("member")).distinct()
    acks = log_.select(F.col("op").alias("tag"), F.explode(F.array(*[F.struct(F.lit(f"r{k}").alias("m"), F.lit(k).alias("k")) for k in range(5)])).alias("a"))
    acks = acks.where((F.col("tag") + F.col("a.k")) % 7 != 0).select(F.lit(1).alias("epoch"), F.col("a.m").alias("member"), "tag")
    return log_, acks, members


@query(ACKS + " select tag from a group by tag having count(distinct mem) = (select count(*) from m)")
def gc_stable_tags(spark, sf_dir):
    return gc.stable(*acknowledged(spark, sf_dir)[1:])


@query(ACKS + ", " + TOMBS.format(log="ops")[5:].replace("a as", "adds as").replace("select distinct a.op from a join", "select distinct a.op from adds a join") + " select op from t where op in (select tag from a group by tag having count(distinct mem) = (select count(*) from m))")
def gc_simple_collect(spark, sf_dir):
    log_, acks, members = acknowledged(spark, sf_dir)
    return gc.collectable(removed(log_)[1], gc.stable(acks, members)).select("op")


# Trees, sequences, documents

TREE = """with recursive n as (
  select 'region' || r_regionkey id, null parent from region union all select 'nation' || n_nationkey, 'region' || n_regionkey from nation
  union all select 'customer' || c_custkey, 'nation' || c_nationkey from customer union all select 'order' || o_orderkey, 'customer' || o_custkey from orders),
k as (select * from n where id not in (select 'nation' || n_nationkey from nation where n_nationkey % 7 = 0)),
live as (select id, 0 depth from k where parent is null union all select k.id, depth + 1 from live join k on k.parent = live.id)
select id, depth from live"""


@query(TREE, with_ops=False)
def ortree_visible(spark, sf_dir):
    def level(name, key, up=None, up_key=None):
        parent = F.concat(F.lit(up), F.col(up_key).cast("string")) if up else F.lit(None).cast("string")
        return table(spark, sf_dir, name if name != "order" else "orders").select(F.concat(F.lit(name), F.col(key).cast("string")).alias("id"), parent.alias("parent"))

    nodes = level("region", "r_regionkey").union(level("nation", "n_nationkey", "region", "n_regionkey")).union(level("customer", "c_custkey", "nation", "c_nationkey")).union(level("order", "o_orderkey", "customer", "o_custkey"))
    tombs = table(spark, sf_dir, "nation").where("n_nationkey % 7 = 0").select(F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("id"))
    return trees.visible(nodes, tombs)


NODES = "nodes as (select conv_id, turn id, lag(turn) over (partition by conv_id, role order by turn) parent, role from conversations)"
WALK = """walk as (select conv_id, id, lpad((999999 - id)::varchar, 6, '0') path from nodes where parent is null
  union all select n.conv_id, n.id, path || '/' || lpad((999999 - n.id)::varchar, 6, '0') from walk w join nodes n on n.conv_id = w.conv_id and n.parent = w.id),
o as (select conv_id, id, row_number() over (partition by conv_id order by path) ord from walk)"""


def turns(spark, sf_dir) -> DataFrame:
    before = F.lag("turn").over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), before.alias("parent"), "role")


@query(f"with recursive {NODES}, {WALK} select conv_id, id, ord from o", with_ops=False)
def rga_conversation_order(spark, sf_dir):
    return sequences.ordered(turns(spark, sf_dir), "conv_id")


@query(f"with {NODES} select conv_id, id, parent from nodes n where parent is not null and id % 5 <> 1 and parent % 5 = 1", with_ops=False)
def rga_missing_parents(spark, sf_dir):
    return sequences.missing_parents(turns(spark, sf_dir).where("id % 5 <> 1"), "conv_id").select("conv_id", "id", "parent")


@query("select doc_id, list_aggregate(list_filter(string_split(text, ''), lambda c, i: i % 7 <> 0), 'string_agg', '') text from documents where length(text) > 0", with_ops=False)
def rga_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = 64
    runs = sequences.chunked(docs, "doc_id", "text", size)
    every = F.explode(F.sequence(F.lit(6), F.greatest(F.lit(6), F.char_length("text") - 1), F.lit(7))).alias("place")
    tombs = docs.select("doc_id", every).select("doc_id", F.floor(F.col("place") / size).alias("id"), (F.col("place") % size).cast("int").alias("place"))
    placed = sequences.ordered(runs, "doc_id").join(sequences.shown(runs, tombs, "doc_id"), ["doc_id", "id"])
    return sequences.text_of(placed, "doc_id", "shown")


@query(f"with recursive {NODES}, {WALK} select conv_id, id, coalesce(sum(case when id % 4 <> 0 then 1 else 0 end) over (partition by conv_id order by ord rows between unbounded preceding and 1 preceding), 0)::bigint rank from o", with_ops=False)
def anchor_rank(spark, sf_dir):
    placed = sequences.ordered(turns(spark, sf_dir), "conv_id")
    return sequences.anchors(placed, "conv_id", F.col("id") % 4 != 0).select("conv_id", "id", "rank")


@query("""with c as (select conv_id, turn, role, case when role is distinct from lag(role) over w or row_number() over w = 1 then 1 else 0 end c from conversations window w as (partition by conv_id order by turn)),
s as (select *, sum(c) over (partition by conv_id order by turn) s from c) select conv_id, min(turn) "first", count(*) length, any_value(role) as role from s group by conv_id, s""", with_ops=False)
def richtext_spans(spark, sf_dir):
    return sequences.spans(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


@query("""with b as (select conv_id, role, coalesce(sum(case when turn % 3 = 2 then 1 else 0 end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint block from conversations)
select conv_id, block, count(*) length, case when min(role) = max(role) and count(role) = count(*) then min(role) end as role from b group by conv_id, block""", with_ops=False)
def richtext_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return sequences.blocks(rows, "conv_id", "turn", F.col("turn") % 3 == 2, "role")


@query()
def movelist_order(spark, sf_dir):
    log_ = ops(spark, sf_dir)
    nodes = log_.select("obj", F.col("elem").alias("id")).distinct()
    moves = log_.select("obj", F.col("elem").alias("id"), F.col("op").alias("tag"), (F.col("elem") * 7 % 120).alias("anchor"), (F.col("ctr") % 10).alias("rank"))
    return sequences.moved(nodes, delivered(moves.withColumn("op", F.col("tag"))), "obj")


@query("select user_id as obj, 'k' as key, arg_max((props->>'k')::bigint, event_id) v from events group by user_id", with_ops=False)
def doctree_values(spark, sf_dir):
    entries = table(spark, sf_dir, "events").select(F.col("user_id").alias("obj"), F.lit("k").alias("key"), "event_id", F.get_json_object("props", "$.k").cast("long").alias("v"))
    return documents.map_values(entries, ["obj", "key"], F.col("event_id"), "v")


# Presence, attachments, measurements

BEATS = "with l as (select elem, max(op) clock, arg_max(obj, op) state, arg_max(ms, op) seen from ops group by elem), n as (select max(ms) now_ms from ops)"


def beats(spark, sf_dir) -> tuple[DataFrame, object]:
    log_ = ops(spark, sf_dir)
    latest = presence.latest_presence(log_.select("elem", F.col("op").alias("clock"), F.when(F.col("obj") != "error", F.col("obj")).alias("state"), F.col("ms").alias("seen")), "elem", "clock", ["state", "seen"])
    return latest.join(log_.agg(F.max("ms").alias("now_ms")), F.lit(True)), F.col("now_ms")


@query(BEATS + " select elem, clock, state from l, n where state <> 'error' and now_ms - seen <= 3600000")
def awareness_active(spark, sf_dir):
    latest, now = beats(spark, sf_dir)
    return presence.active(latest, now, "seen", 3600000, "state").select("elem", "clock", "state")


@query(BEATS + " select elem, clock from l, n where now_ms - seen >= 3600000")
def liveness_suspects(spark, sf_dir):
    latest, now = beats(spark, sf_dir)
    return presence.suspects(latest, now, "seen", 3600000).select("elem", "clock")


@query("""with m as (select c_nationkey::varchar grp, c_custkey::varchar mem from customer),
p as (select a.grp, a.mem self, b.mem peer, row_number() over (partition by a.grp, a.mem order by sha256(a.grp || ':' || a.mem || ':7:' || b.mem), b.mem) rank from m a join m b on a.grp = b.grp and a.mem <> b.mem)
select grp, self, peer, rank from p where rank <= 3""", with_ops=False)
def gossip_peers(spark, sf_dir):
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("grp"), F.col("c_custkey").cast("string").alias("mem"))
    return presence.gossip_peers(members, "grp", "mem", F.lit(7), 3).select("grp", "self", "peer", *long("rank"))


VIEWS = """with v as (select o_custkey grp, row_number() over (partition by o_custkey order by o_orderkey) epoch, sha256(o_orderkey::varchar) hash,
  case when o_orderkey % 9 = 0 then 'forged' else lag(sha256(o_orderkey::varchar)) over (partition by o_custkey order by o_orderkey) end prev from orders)"""


@query(VIEWS + " select grp, epoch, (lag(epoch) over w is null or (epoch = lag(epoch) over w + 1 and prev = lag(hash) over w)) valid from v window w as (partition by grp order by epoch)", with_ops=False)
def membership_chain(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    hashed = F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256)
    views = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.row_number().over(w).cast("long").alias("epoch"), hashed.alias("hash"), F.when(F.col("o_orderkey") % 9 == 0, "forged").otherwise(F.lag(hashed).over(w)).alias("prev"))
    return presence.view_chain(views, "grp").select("grp", "epoch", "valid")


@query("select doc_id, octet_length(encode(text)) = n_chars size_ok, doc_id % 10 <> 3 digest_ok from documents where text is not null", with_ops=False)
def attachment_verify(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    claimed = F.sha2(F.concat("text", F.when(F.col("doc_id") % 10 == 3, "x").otherwise("")).cast("binary"), 256)
    return documents.verified(docs, F.col("text"), F.col("n_chars"), claimed).select("doc_id", "size_ok", "digest_ok")


@query(f"""{TOMBS.format(log="ops")} select 'g-set' as type, (select count(*) from (select distinct obj, elem from ops)) element_count, 0::bigint tombstone_count
union all select 'or-set', (select count(distinct elem) from a where op not in (select op from t)), (select count(*) from t)
union all select 'g-counter', (select count(*) from (select distinct obj, replica from ops)), 0::bigint""")
def state_snapshot(spark, sf_dir):
    log_ = ops(spark, sf_dir)
    adds, tombs = removed(log_)
    rows = [snapshots.diagnostics("g-set", log_.select("obj", "elem").distinct()), snapshots.diagnostics("or-set", sets.live(adds, tombs).select("elem").distinct(), tombs), snapshots.diagnostics("g-counter", counters.merged(running(spark, sf_dir)))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("select obj, count(*) n, quantile_disc(amt, 0.5) p50, quantile_disc(amt, 0.95) p95, quantile_disc(amt, 0.99) p99, max(amt) most from ops group by obj")
def latency_percentiles(spark, sf_dir):
    return documents.nearest_rank(ops(spark, sf_dir), "obj", "amt", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("""with m as (select l_suppkey, count(*) filter (l_linenumber % 2 = 1) n_base, count(*) filter (l_linenumber % 2 = 0) n_candidate,
  median(l_quantity) filter (l_linenumber % 2 = 1) base, median(l_quantity) filter (l_linenumber % 2 = 0) candidate from lineitem group by l_suppkey)
select *, candidate * 100 > base * 105 regressed from m where n_base >= 20 and n_candidate >= 20""", with_ops=False)
def benchmark_check(spark, sf_dir):
    return documents.regressions(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", F.col("l_linenumber") % 2 == 1, 20, 5)


@query("""with recursive e as (select o_orderkey id, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) parent, o_custkey from orders),
h as (select max(o_orderkey) id from orders group by o_custkey),
s as (select id head, id, 0 distance from h union all select head, e.parent, distance + 1 from s join e on e.id = s.id where e.parent is not null)
select head, id, distance from s""", with_ops=False)
def version_history(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    edges = orders.select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("parent"))
    return trees.ancestry(edges, orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("id")).select("id"))


# Frames and streams


@query(f"{RUNNING} select obj, 1 as type_id, 'utf8' codec, replica, max(component)::bigint component from r group by obj, replica")
def frame_round_trip(spark, sf_dir):
    state = counters.merged(running(spark, sf_dir))
    rows = state.groupBy("obj").agg(F.collect_list("replica").alias("names"), F.collect_list("component").alias("counts"))
    framed = rows.select("obj", frames.encode_frame(F.lit(1), F.lit("utf8"), frames.encode_counter("names", "counts"), F.when(F.length("obj") % 2 == 0, 2).otherwise(1)).alias("frame"))
    opened = framed.select("obj", frames.decode_frame("frame").alias("f")).where("f.error is null")
    known = opened.join(F.broadcast(frames.frame_types(spark).select(F.col("state_id").alias("known"))), F.col("f.type_id") == F.col("known"), "left_semi")
    return known.select("obj", F.col("f.type_id").alias("type_id"), F.col("f.codec").alias("codec"), F.explode(frames.decode_counter("f.payload")).alias("c")).select("obj", "type_id", "codec", "c.*")


@query(f"{RUNNING}, m as (select obj, replica, max(component) c from r group by all) select obj, sum(c)::bigint v from m group by obj")
def stream_counter_value(spark, sf_dir):
    return live.counter_value(spark, running(spark, sf_dir))


@query("select elem actor, max(op) clock, arg_max(obj, op) state, arg_max(ms, op) seen from ops group by elem")
def stream_presence(spark, sf_dir):
    return live.presence(spark, ops(spark, sf_dir).select(F.col("elem").alias("actor"), F.col("op").alias("clock"), F.col("obj").alias("state"), F.col("ms").alias("seen")))


@query(RANKED + " select replica, coalesce(max(case when ctr = k then ctr end), 0)::bigint frontier, count(*) filter (ctr <> k) pending from n group by replica")
def stream_inbox(spark, sf_dir):
    return live.inbox(spark, lossy(ops(spark, sf_dir)).select("replica", "ctr"))


from . import editing, protocol  # noqa: E402, F401  (they register further queries)
