"""Registered queries on edits of sequences, rich texts, trees and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import masked
from ..functions.tags import tag
from ..operators import editing, protocol, registers, sequences, trees
from ..sources.oplog import delivered, ops, table
from .catalogue import NODES, WALK, query, turns

PLACED = f"with recursive {NODES}, {WALK}, v as (select *, row_number() over (partition by conv_id order by ord) - 1 off, count(*) over (partition by conv_id) n from o where id % 4 <> 0)"
def shown():
    return F.col("id") % 4 != 0


def placed(spark, sf_dir):
    return sequences.ordered(turns(spark, sf_dir), "conv_id")


def convs(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id").distinct()


@query(PLACED + ", e as (select distinct conv_id, conv_id % 6 pos from o) select e.conv_id, e.pos as \"offset\", e.pos <= coalesce((select max(n) from v where v.conv_id = e.conv_id), 0) fits, case when e.pos <= coalesce((select max(n) from v where v.conv_id = e.conv_id), 0) then (select id from v where v.conv_id = e.conv_id and off = e.pos - 1) end parent from e", with_ops=False)
def list_insert(spark, sf_dir):
    edits = convs(spark, sf_dir).withColumn("offset", F.col("conv_id") % 6)
    return editing.inserted(placed(spark, sf_dir), edits, "conv_id", shown()).select("conv_id", "offset", "fits", "parent")


@query(PLACED + " select conv_id, id from v where off >= conv_id % 3 and off < conv_id % 3 + 2 and conv_id % 3 + 2 <= n", with_ops=False)
def list_delete(spark, sf_dir):
    edits = convs(spark, sf_dir).select("conv_id", (F.col("conv_id") % 3).alias("offset"), F.lit(2).alias("count"))
    return editing.deleted(placed(spark, sf_dir), edits, "conv_id", shown())


@query(PLACED + " select conv_id, max(n) length, max(id) filter (off = conv_id % 3) as second, string_agg(id, ',' order by off) ids from v group by conv_id", with_ops=False)
def list_values(spark, sf_dir):
    at = editing.offsets(placed(spark, sf_dir), "conv_id", shown())
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__offset", "id"))), lambda x: x["id"].cast("string")), ",")
    return at.groupBy("conv_id").agg(F.max("__length").alias("length"), F.max(F.when(F.col("__offset") == F.col("conv_id") % 3, F.col("id"))).alias("second"), ids.alias("ids"))


@query(PLACED + """, m as (select *, least(1, n - 1) frm, conv_id % 4 dst from v where n >= 6),
p as (select *, case when off between frm and frm + 1 then dst + off - frm else (off - case when off >= frm + 2 then 2 else 0 end) + case when (off - case when off >= frm + 2 then 2 else 0 end) >= dst then 2 else 0 end end place from m)
select conv_id, id, place, lag(id) over (partition by conv_id order by place) as before, frm <> dst and place >= least(frm, dst) changed from p""", with_ops=False)
def list_move(spark, sf_dir):
    order = placed(spark, sf_dir)
    long_ = editing.offsets(order, "conv_id", shown()).where("__length >= 6").select("conv_id").distinct()
    moves = long_.select("conv_id", F.lit(1).alias("from"), F.lit(2).alias("count"), (F.col("conv_id") % 4).alias("to"))
    return editing.moved_order(order, moves, "conv_id", shown())


EDITS = "e as (select conv_id, n, op, cnt from (select distinct conv_id from conversations), (values (1, 'retain', 1), (2, 'insert', 3), (3, 'delete', 2), (4, 'retain', 1), (5, 'insert', 1), (6, 'delete', 1)) x(n, op, cnt))"


@query(f"with {EDITS} select conv_id, n, op, cnt as \"count\", coalesce(sum(case when op = 'insert' then 0 else cnt end) over (partition by conv_id order by n rows between unbounded preceding and 1 preceding), 0)::bigint \"offset\" from e", with_ops=False)
def editor_delta(spark, sf_dir):
    steps = [(1, "retain", 1), (2, "insert", 3), (3, "delete", 2), (4, "retain", 1), (5, "insert", 1), (6, "delete", 1)]
    ops_ = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(op).alias("op"), F.lit(c).alias("count")) for n, op, c in steps])).alias("s")
    return editing.editor(convs(spark, sf_dir).select("conv_id", ops_).select("conv_id", "s.*"), "conv_id")


FORMATS = """f(pos, cnt, key, tag, value) as (values (0, 4, 'bold', 1, 'true'), (2, 1, 'bold', 3, null), (1, 3, 'color', 2, 'red'), (3, 2, 'color', 4, 'blue'), (2, 1, 'bold', 2, 'true')),
q as (select *, ord - 1 off from o), m as (select q.conv_id, q.id, f.key, arg_max(coalesce(f.value, ''), f.tag) value from q join f on off >= pos and off < pos + cnt group by all),
a as (select conv_id, id, string_agg(key || '=' || value, ',' order by key) attributes from m where value <> '' group by all)"""


def formats(spark, sf_dir):
    rows = [(0, 4, "bold", 1, "true"), (2, 1, "bold", 3, None), (1, 3, "color", 2, "red"), (3, 2, "color", 4, "blue"), (2, 1, "bold", 2, "true")]
    made = F.explode(F.array(*[F.struct(F.lit(o).alias("offset"), F.lit(c).alias("count"), F.lit(k).alias("key"), F.lit(t).alias("tag"), F.lit(v).cast("string").alias("value")) for o, c, k, t, v in rows])).alias("f")
    return convs(spark, sf_dir).select("conv_id", made).select("conv_id", "f.*")


@query(f"with recursive {NODES}, {WALK}, {FORMATS} select conv_id, id, attributes from a", with_ops=False)
def richtext_marks(spark, sf_dir):
    return editing.attributes(editing.marked(placed(spark, sf_dir), formats(spark, sf_dir), "conv_id"), "conv_id")


@query(f"""with recursive {NODES}, {WALK}, {FORMATS}, x as (select q.conv_id, q.ord, a.attributes from q left join a on a.conv_id = q.conv_id and a.id = q.id),
c as (select *, case when ord = 1 or attributes is distinct from lag(attributes) over (partition by conv_id order by ord) then 1 else 0 end c from x), s as (select *, sum(c) over (partition by conv_id order by ord) s from c)
select conv_id, min(ord) "first", count(*) length, any_value(attributes) attributes from s group by conv_id, s""", with_ops=False)
def richtext_mark_spans(spark, sf_dir):
    order = placed(spark, sf_dir)
    live = editing.attributes(editing.marked(order, formats(spark, sf_dir), "conv_id"), "conv_id")
    return sequences.spans(order.join(live, ["conv_id", "id"], "left"), "conv_id", "ord", "attributes")


@query("select conv_id, turn, role embed from conversations where turn % 6 = 5 and role is not null", with_ops=False)
def richtext_embeds(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), F.when(F.col("turn") % 6 == 5, F.col("role")).alias("value"))
    marks = rows.where("value is not null").select("conv_id", "id", F.lit("embed").alias("key"), F.lit(1).alias("tag"), "value")
    return editing.attributes(marks, "conv_id").select("conv_id", F.col("id").alias("turn"), F.substring_index("attributes", "=", -1).alias("embed"))


@query(f"with recursive {NODES}, {WALK}, k as (select * from o where id % 7 <> 3) select conv_id, id, (select count(*) from k where k.conv_id = o.conv_id and k.ord < o.ord and k.id % 4 <> 0)::bigint \"offset\", false gone from o where id % 7 <> 3 union all select conv_id, id, null, true from o where id % 7 = 3", with_ops=False)
def anchor_resolve(spark, sf_dir):
    order = placed(spark, sf_dir)
    return editing.resolved(order.select("conv_id", "id"), order.where("id % 7 <> 3"), "conv_id", shown()).select("conv_id", "id", "offset", "gone")


@query(f"with recursive {NODES}, k as (select * from nodes where id % 5 <> 1), lost as (select conv_id, id from k where parent is not null and parent % 5 = 1 union all select k.conv_id, k.id from lost l join k on k.conv_id = l.conv_id and k.parent = l.id) select conv_id, id from lost", with_ops=False)
def rga_pending(spark, sf_dir):
    return editing.waiting(turns(spark, sf_dir).where("id % 5 <> 1"), "conv_id")


@query(f"with recursive {NODES}, held as (select conv_id, parent id from nodes where id % 3 = 0 and parent is not null union select n.conv_id, n.parent from held h join nodes n on n.conv_id = h.conv_id and n.id = h.id where n.parent is not null) select conv_id, id from nodes n where id % 3 <> 0 and not exists (select 1 from held h where h.conv_id = n.conv_id and h.id = n.id)", with_ops=False)
def compact_eligible(spark, sf_dir):
    return editing.collectable(turns(spark, sf_dir), "conv_id", F.col("id") % 3 != 0)


UNDO = """with recursive k as (select elem, op, case obj when 'error' then 'undo' when 'view' then 'redo' else 'do' end kind, row_number() over (partition by elem order by op) n from ops),
s as (select elem, 0::bigint n, []::bigint[] done, []::bigint[] gone from (select distinct elem from ops)
  union all select k.elem, k.n, case kind when 'do' then list_append(done, k.op) when 'undo' then done[:-2] else case when len(gone) > 0 then list_append(done, gone[len(gone)]) else done end end,
    case kind when 'do' then [] when 'undo' then case when len(done) > 0 then list_append(gone, done[len(done)]) else gone end else gone[:-2] end from s join k on k.elem = s.elem and k.n = s.n + 1)
select k.elem, k.op, list_contains(s.done, k.op) live from k join s on s.elem = k.elem and s.n = (select max(n) from k x where x.elem = k.elem)"""


@query(UNDO)
def undo_in_effect(spark, sf_dir):
    kind = F.when(F.col("obj") == "error", "undo").when(F.col("obj") == "view", "redo").otherwise("do")
    return editing.in_effect(ops(spark, sf_dir), "elem", "op", kind)


TREE = """with recursive n as (select 'region' || r_regionkey id, null parent, r_regionkey::bigint k from region union all select 'nation' || n_nationkey, 'region' || n_regionkey, n_nationkey from nation union all select 'customer' || c_custkey, 'nation' || c_nationkey, c_custkey from customer),
w as (select id, lpad((999999999 - k)::varchar, 9, '0') path from n where parent is null union all select n.id, path || '/' || lpad((999999999 - n.k)::varchar, 9, '0') from w join n on n.parent = w.id)"""


def tree_nodes(spark, sf_dir):
    def level(name, key, up, up_key):
        parent = F.concat(F.lit(up), F.col(up_key).cast("string")) if up else F.lit(None).cast("string")
        return table(spark, sf_dir, name).select(F.concat(F.lit(name), F.col(key).cast("string")).alias("id"), parent.alias("parent"), F.col(key).cast("long").alias("k"))

    return level("region", "r_regionkey", None, None).union(level("nation", "n_nationkey", "region", "n_regionkey")).union(level("customer", "c_custkey", "nation", "c_nationkey"))


@query(TREE + " select id, path from w", with_ops=False)
def ortree_order(spark, sf_dir):
    return trees.paths(tree_nodes(spark, sf_dir), "k").select("id", "path")


@query(TREE + ", x as (select id, case when id = 'nation3' then 'customer1' when k % 11 = 5 and parent like 'nation%' then 'nowhere' when id = 'region1' then 'nation3' else parent end parent from n), r as (select id from x where parent is null union all select x.id from r join x on x.parent = r.id), u as (select x.id from x left join x p on p.id = x.parent where x.parent is not null and p.id is null union all select x.id from u join x on x.parent = u.id) select id, case when id in (select id from u) then 'waits' else 'cycle' end problem from x where id not in (select id from r)", with_ops=False)
def ortree_invalid(spark, sf_dir):
    k, parent = F.col("k"), F.col("parent")
    odd = F.when(F.col("id") == "nation3", "customer1").when((k % 11 == 5) & parent.startswith("nation"), "nowhere").when(F.col("id") == "region1", "nation3").otherwise(parent)
    return trees.unreachable(tree_nodes(spark, sf_dir).withColumn("parent", odd).select("id", "parent"))


@query(TREE + " select id, parent, parent in (select id from n where k % 7 <> 0) accepted from n where parent is not null", with_ops=False)
def ortree_add(spark, sf_dir):
    nodes = tree_nodes(spark, sf_dir)
    return trees.added(nodes.where("parent is not null").select("id", "parent"), nodes.where("k % 7 <> 0").select("id"))


@query("""with a as (select user_id usr, event_id id, event_type kind, event_id % 6 <> 0 shown from events),
v as (select *, row_number() over (partition by usr order by id desc) - 1 idx from a where shown) select usr, idx, id, kind as "value" from v""", with_ops=False)
def doctree_arrays(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("usr"), F.col("event_id").alias("id"), F.lit(None).cast("long").alias("parent"), F.col("event_type").alias("value"))
    order = sequences.ordered(rows, "usr").join(rows.select("usr", "id", "value"), ["usr", "id"])
    return editing.offsets(order, "usr", F.col("id") % 6 != 0).select("usr", F.col("__offset").alias("idx"), "id", "value")


@query("with c as (select event_id child, user_id owner from events union all select event_id, user_id + 1 from events where event_id % 50 = 0) select child, count(distinct owner) owners from c group by child having count(distinct owner) > 1", with_ops=False)
def doctree_owners(spark, sf_dir):
    from ..operators import documents

    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("child"), F.col("user_id").alias("owner"))
    return documents.owners(rows.unionAll(rows.where("child % 50 = 0").withColumn("owner", F.col("owner") + 1)))


@query("with m as (select user_id usr, event_type key, arg_max((props->>'k')::bigint, event_id) v from events group by all) select usr, '{' || string_agg('\"' || key || '\":' || v, ',' order by key) || '}' as json from m group by usr", with_ops=False)
def doctree_json(spark, sf_dir):
    from ..operators import documents

    entries = table(spark, sf_dir, "events").select(F.col("user_id").alias("usr"), F.col("event_type").alias("key"), "event_id", F.get_json_object("props", "$.k").cast("long").alias("v"))
    latest = documents.map_values(entries, ["usr", "key"], F.col("event_id"), "v")
    fields = F.array_sort(F.collect_list(F.struct("key", "v")))
    return latest.groupBy("usr").agg(F.to_json(F.map_from_entries(fields)).alias("json"))


@query("select c_nationkey grp, '<items><item id=\"' || string_agg(c_custkey || '\">' || replace(replace(c_name, '#', '&amp;'), '-', '&lt;') || '</item>', '<item id=\"' order by c_custkey) || '</items>' as xml, count(*) n, max(c_custkey) \"last\" from customer group by c_nationkey", with_ops=False)
def xml_fragment(spark, sf_dir):
    name = F.translate("c_name", "#-", "&<")
    item = editing.element("item", {"id": F.col("c_custkey").cast("string")}, editing.escaped(name))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.struct("c_custkey", item.alias("x")).alias("s"))
    made = rows.groupBy("grp").agg(F.array_sort(F.collect_list("s")).alias("s")).select("grp", editing.element("items", {}, F.array_join(F.transform("s", lambda s: s["x"]), "")).alias("xml"))
    ids = F.transform(F.xpath("xml", F.lit("/items/item/@id")), lambda x: x.cast("long"))
    return made.select("grp", "xml", F.size(ids).cast("long").alias("n"), F.array_max(ids).alias("last"))


@query("with l as (select source key, arg_max(doc_id, doc_id) last, arg_max(doc_id % 4 <> 0, doc_id) present, arg_max(n_chars, doc_id) size from documents where source is not null group by source) select key, last, size from l where present", with_ops=False)
def attachment_register(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("key"), F.col("doc_id").alias("last"), (F.col("doc_id") % 4 != 0).alias("present"), F.col("n_chars").alias("size"))
    return registers.latest(rows, ["key"], ["last", "present", "size"], F.struct("last")).where("present").select("key", "last", "size")


@query("select obj doc, count(*) filter (obj in ('click', 'view')) applied, count(*) filter (obj not in ('click', 'view')) rejected from ops group by obj")
def document_manager(spark, sf_dir):
    known = ops(spark, sf_dir).where(F.col("obj").isin("click", "view")).select(F.col("obj").alias("__known")).distinct()
    routed = ops(spark, sf_dir).join(known, F.col("obj") == F.col("__known"), "left")
    return routed.groupBy(F.col("obj").alias("doc")).agg(F.count("__known").alias("applied"), F.count_if(F.col("__known").isNull()).alias("rejected"))


@query("select elem, op, row_number() over (partition by elem order by op) clock, case when obj = 'error' then null else obj end state from ops")
def awareness_writes(spark, sf_dir):
    clock = F.row_number().over(Window.partitionBy("elem").orderBy("op")).cast("long")
    return ops(spark, sf_dir).select("elem", "op", clock.alias("clock"), F.when(F.col("obj") != "error", F.col("obj")).alias("state"))


@query("with u as (select elem, obj, op, amt, row_number() over (partition by elem order by op) n from ops) select elem, n, obj as key, case when obj = 'error' then 'delete' else 'set' end kind, case when obj <> 'error' then amt end v from u")
def shared_updates(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("elem").orderBy("op")).cast("long")
    live = F.col("obj") != "error"
    return ops(spark, sf_dir).select("elem", n.alias("n"), F.col("obj").alias("key"), F.when(live, "set").otherwise("delete").alias("kind"), F.when(live, F.col("amt")).alias("v"))


@query("select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(role, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', '0', 'g') role from conversations where role is not null", with_ops=False)
def obfuscated_copy(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role is not null").select("conv_id", "turn", masked(F.col("role")).alias("role"))


@query("with x as (select conv_id, turn, role, case when turn % 9 = 4 then turn + 1 else turn end par from conversations union all select conv_id, turn, role, turn from conversations where turn % 9 = 4) select conv_id, turn, count(*) n from x group by all having count(distinct par) > 1", with_ops=False)
def rga_identity_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 9 == 4, F.col("turn") + 1).otherwise(F.col("turn")).alias("par"))
    again = table(spark, sf_dir, "conversations").where("turn % 9 = 4").select("conv_id", "turn", F.col("turn").alias("par"))
    return protocol.conflicts(rows.unionAll(again), ["conv_id", "turn"], [F.col("par")])


MV = """with own as (select obj, replica, max(ctr) ctr from ops group by all), w as (select obj, replica writer, max(op) // 500 upto from ops group by all),
seen as (select o.obj, o.replica, max(o.ctr) seen from ops o join w on w.obj = o.obj and w.writer <> o.replica and o.op // 500 < w.upto group by all),
a as (select o.obj, o.replica, o.ctr, p.amt from own o left join seen s on s.obj = o.obj and s.replica = o.replica join ops p on p.obj = o.obj and p.replica = o.replica and p.ctr = o.ctr where o.ctr > coalesce(seen, 0))"""


@query(MV + " select obj, string_agg(replica || ':' || ctr || '=' || amt, ',' order by replica, ctr) dots, case when count(*) = 1 then max(amt) end v from a group by obj")
def mv_register_dots(spark, sf_dir):
    writes = ops(spark, sf_dir)
    found = registers.multi_value(writes, registers.contexts_at_rounds(writes, 500))
    return registers.dots(found, "obj", "amt")


@query("select doc_id, octet_length(encode(coalesce(text, '')))::bigint bytes, true valid, octet_length(encode(coalesce(text, ''))) = 0 as empty from documents", with_ops=False)
def utf8_valid(spark, sf_dir):
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    return rows.select("doc_id", F.octet_length("raw").cast("long").alias("bytes"), F.is_valid_utf8(F.col("raw").cast("string")).alias("valid"), (F.octet_length("raw") == 0).alias("empty"))


@query("with m as (select elem, max((ms, ctr, replica)) t, arg_max(obj, (ms, ctr, replica)) obj from deliveries group by elem) select elem, t[1] wall, t[2] logical, obj <> 'error' present, count(*) over (partition by obj <> 'error') same from m")
def lww_retained_keys(spark, sf_dir):
    found = registers.latest(delivered(ops(spark, sf_dir)), ["elem"], ["obj"], tag("ms", "ctr", "replica")).withColumn("present", F.col("obj") != "error")
    sizes = found.groupBy(F.col("present").alias("p")).agg(F.count("*").alias("same"))
    return found.join(F.broadcast(sizes), F.col("present") == F.col("p")).select("elem", "tag.wall", "tag.logical", "present", "same")
