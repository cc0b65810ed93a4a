"""Queries of the facade, the search pipeline and the smaller graph operators on the driver's tables, and SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.operators import channels, facade, lookup, mining, paths, structure, traverse
from codeloom.plans.graph import PropertyGraph, from_tables
from codeloom.queries import _R, QUERIES, _t, dsl, query
from codeloom.sources import store

# --- facade ---


@query("select e.dst as id, e.kind, e.src as user, n.name as user_name from edges e join nodes n on n.id = e.src where e.kind <> 'Contains' and e.dst in ('supplier:1', 'part:3')")
def usages(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    return facade.usages(g, g.nodes.where("id in ('supplier:1', 'part:3')").select("id"))


@query("""with a as (select distinct 'order:' || o_orderkey as id, 'customer:1' as f from orders where o_custkey = 1),
  b as (select 'part:' || l_partkey as id, min('order:' || l_orderkey) as f from lineitem join orders on o_orderkey = l_orderkey where o_custkey = 1 group by 1)
  select id, 1 as depth, f as "from", 'Calls' as kind from a union all select id, 2, f, 'UsesType' from b""", graph=False)
def relation_layers(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    return facade.relation_layers(g.edges, g.nodes.where("id = 'customer:1'").select("id"), 2, ("Calls", "UsesType"))


@query("select 'customer:' || o_custkey as src, 'order:' || o_orderkey as dst, 'Calls' as kind, 1.0 as weight from orders where o_custkey in (select o_custkey from orders where o_orderkey = 1)", graph=False)
def call_graph(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    first = traverse.bfs(traverse.reversed_edges(g.edges_of_kind("Calls")), g.nodes.where("id = 'order:1'").select("id")).where("depth = 1").select("id")
    return facade.call_graph(g, first, 1)


@query("select distinct 'supplier:' || l_suppkey as id, true as above from lineitem where l_partkey = 1", graph=False)
def type_hierarchy_above(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    return facade.type_hierarchy(g, g.nodes.where("id = 'part:1'").select("id"))


@query("select distinct 'part:' || l_partkey as id, false as above from lineitem where l_suppkey = 1", graph=False)
def type_hierarchy_below(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    return facade.type_hierarchy(g, g.nodes.where("id = 'supplier:1'").select("id"))


@query("""select 'customer:1' as id, 'ancestor' as role, 'nation:' || c_nationkey as other, 'Contains' as kind from customer where c_custkey = 1
  union all select 'customer:1', 'ancestor', 'region:' || n_regionkey, 'Contains' from customer join nation on n_nationkey = c_nationkey where c_custkey = 1
  union all select 'customer:1', 'outgoing', 'order:' || o_orderkey, 'Calls' from orders where o_custkey = 1""", graph=False)
def node_context(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    return facade.node_context(g, g.nodes.where("id = 'customer:1'").select("id"))


@query("""select distinct 'nation:' || c_nationkey as src, 'customer:' || c_custkey as dst from orders join customer on c_custkey = o_custkey
  union select 'customer:' || o_custkey, p_brand from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey
  union select p_brand, 'nation:' || s_nationkey from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey""", graph=False)
def file_dependencies(spark, sf_dir):
    return facade.file_edges(from_tables(spark, sf_dir))


@query("""with f as (select distinct p_brand as f, '' as folder from part union all select 'world', '' union all select distinct 'region:' || n_regionkey, 'region' from nation
  union select 'nation:' || c_nationkey, 'nation' from customer union select 'nation:' || s_nationkey, 'nation' from supplier union select 'customer:' || o_custkey, 'customer' from orders)
  select folder, f as file_path, count(*) over (partition by folder) as n from f""", graph=False)
def module_structure(spark, sf_dir):
    return facade.module_structure(from_tables(spark, sf_dir).nodes)


#: Transitions between event types that follow each other for a user; small and full of cycles.
EVENT_LINKS = "e as (select distinct a as src, b as dst from (select event_type as a, lead(event_type) over (partition by user_id order by ts, event_id) as b from events) where b is not null)"


def _event_links(spark, sf_dir):
    from pyspark.sql import Window

    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _t(spark, sf_dir, "events").select(F.col("event_type").alias("src"), nxt.alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


@query(f"""with recursive {EVENT_LINKS}, walk(src, dst) as (select src, dst from e union select w.src, e.dst from walk w join e on e.src = w.dst)
  select a.src as id, max(a.dst) as component from walk a join walk b on a.src = b.dst and a.dst = b.src where a.src in (select src from walk group by src, dst having src = dst) group by a.src
  having count(distinct a.dst) > 1""", graph=False)
def circular_files(spark, sf_dir):
    return facade.circular_files(_event_links(spark, sf_dir).select("src", "dst"))


@query("select p_brand as file_path, count(*) as n from part where p_brand = (select p_brand from part group by 1 order by count(*) desc, 1 limit 1) group by 1 having count(*) >= 3 and count(*) >= 0.02 * (select count(*) from part)", graph=False)
def top_file(spark, sf_dir):
    return facade.top_file(from_tables(spark, sf_dir).of_kind("Struct"), 3, 0.02)


@query("select doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)) as slice from documents where text is not null", graph=False)
def code_slice(spark, sf_dir):
    return facade.code_slice(_t(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text", F.lit(2), F.lit(3))


@query("""with d as (select kind as part, count(*) as definitions from nodes group by 1), x as (select split_part(src, ':', 1) as a, split_part(dst, ':', 1) as b, count(*) as n from edges where kind <> 'Contains' group by 1, 2),
  k as (select 'customer' as t, 'Function' as kind union all select 'order', 'Function' union all select 'part', 'Struct' union all select 'supplier', 'Trait'),
  y as (select p.kind as a, q.kind as b, sum(n) as n from x join k p on p.t = a join k q on q.t = b where p.kind <> q.kind group by 1, 2)
  select part, definitions, cast(coalesce((select sum(n) from y where a = part), 0) as bigint) as uses, cast(coalesce((select sum(n) from y where b = part), 0) as bigint) as used from d""")
def architecture(spark, sf_dir):
    return facade.architecture(from_tables(spark, sf_dir), F.col("kind"))


@query("""select id, kind, user, user_name from (select *, row_number() over (partition by id, kind order by user) as k from
  (select e.dst as id, e.kind, e.src as user, n.name as user_name from edges e join nodes n on n.id = e.src where e.kind in ('UsesType', 'Implements') and e.dst in ('part:1', 'part:2', 'supplier:1'))) where k <= 3""")
def xref(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    return facade.xref(g, g.nodes.where("id in ('part:1', 'part:2', 'supplier:1')").select("id"), 3)


@query("""with o as (select distinct l_orderkey as k from lineitem where l_partkey = 1), c as (select distinct o_custkey as k from orders where o_orderkey in (select k from o)),
  n as (select 'customer:' || o_custkey as f from orders where o_orderkey in (select k from o) union all select 'nation:' || c_nationkey from customer where c_custkey in (select k from c))
  select count(*) as dependents, count(distinct f) as files, 0 as tests from n""", graph=False)
def blast_radius(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    return facade.blast_radius(g, g.nodes.where("id = 'part:1'").select("id"), 2)


@query("select 'part:' || p_partkey as id, 'part::' || p_name as qualified_name, 1 as score from part where p_name = (select max(p_name) from part)", graph=False)
def disambiguate(spark, sf_dir):
    """Parts that share the last of all names."""
    nodes = from_tables(spark, sf_dir).of_kind("Struct")
    return facade.disambiguate(nodes, nodes.agg(F.max("name")).first()[0])


@query("""select (select count(*) from nodes) as nodes, (select count(*) from edges) as edges,
  cast((select sum(cast('0x' || substr(md5(concat_ws('|', id, kind, name)), 1, 8) as bigint)) from nodes) + (select sum(cast('0x' || substr(md5(concat_ws('|', src, dst, kind)), 1, 8) as bigint)) from edges) as bigint) as digest""")
def graph_fingerprint(spark, sf_dir):
    return facade.fingerprint(from_tables(spark, sf_dir))


_NATION_LINKS = "e as (select 'r' || n_regionkey as src, 'n' || n_nationkey as dst, 1.0 + n_nationkey % 3 as weight from nation union all select 'n' || n_nationkey, 'r' || (n_regionkey + 1) % 5, 2.0 from nation)"


def _nation_links(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    name = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    down = n.select(name("r", F.col("n_regionkey")).alias("src"), name("n", F.col("n_nationkey")).alias("dst"), (1.0 + F.col("n_nationkey") % 3).alias("weight"))
    return down.unionByName(n.select(name("n", F.col("n_nationkey")).alias("src"), name("r", (F.col("n_regionkey") + 1) % 5).alias("dst"), F.lit(2.0).alias("weight")))


_ALL_PAIRS = f"""with recursive {_NATION_LINKS}, v as (select distinct src as a from e union select dst from e),
  walk(a, b, d, k) as (select a, a, cast(0 as double), 0 from v union select w.a, e.dst, w.d + cast(e.weight as double), w.k + 1 from walk w join e on e.src = w.b where w.k < 11),
  p as (select a, b, min(d) as distance from walk group by 1, 2)"""


@query(_ALL_PAIRS + " select a, b, distance from p", graph=False)
def all_pairs(spark, sf_dir):
    return facade.all_pairs(_nation_links(spark, sf_dir))


@query(_ALL_PAIRS + " select b as id, distance from p where a = 'r0' and b <> 'r0' order by distance, b limit 7", graph=False)
def nearest_neighbours(spark, sf_dir):
    links = _nation_links(spark, sf_dir)
    return facade.nearest(links, spark.createDataFrame([("r0",)], "id string"), 7)


@query("""select 'n' || n_nationkey as id, 'n' || n_nationkey as dominator from nation union all select 'n' || n_nationkey, 'world' from nation union all select 'n' || n_nationkey, 'r' || n_regionkey from nation
  union all select distinct 'r' || n_regionkey, 'r' || n_regionkey from nation union all select distinct 'r' || n_regionkey, 'world' from nation union all select 'world', 'world'""", graph=False)
def post_dominators(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    up = n.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst")).unionByName(n.select(name("r", "n_regionkey").alias("src"), F.lit("world").alias("dst")).distinct())
    return facade.post_dominators(up, spark.createDataFrame([("world",)], "id string"))


@query("select 'n' || n_nationkey as id, 0 as stratum from nation union all select distinct 'r' || n_regionkey, 1 from nation union all select 'world', 2", graph=False)
def strata(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    rules = n.select(name("r", "n_regionkey").alias("head"), name("n", "n_nationkey").alias("body"), F.lit(True).alias("negated"))
    return facade.strata(rules.unionByName(n.select(F.lit("world").alias("head"), name("r", "n_regionkey").alias("body"), F.lit(True).alias("negated"))))


@query("select o_orderkey, o_totalprice from orders where o_orderkey > 100 order by o_orderkey limit 25", graph=False)
def keyset_page(spark, sf_dir):
    return facade.page_after(_t(spark, sf_dir, "orders"), "o_orderkey", 100, 25).select("o_orderkey", "o_totalprice")


@query("select id, kind, name from nodes where id = 'supplier:3'")
def point_lookup(spark, sf_dir):
    return from_tables(spark, sf_dir).nodes.where("id = 'supplier:3'").select("id", "kind", "name")


@query("select event_type, count(*) as n from events group by 1 order by 2 desc, 1 limit 3", graph=False)
def hottest_items(spark, sf_dir):
    return facade.hottest(_t(spark, sf_dir, "events"), "event_type", 3)


@query("select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by p_partkey) as k from part) where k <= 2", graph=False)
def per_group_cap(spark, sf_dir):
    return facade.first_of_each(_t(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_brand"], 2, "p_partkey")


@query("""select page_id, regexp_matches(url, '(?i)(^|/)(tests?|__tests__|spec|specs|testing)/|[._-](test|spec|tests)\\.[a-z]+$|(^|/)test_[^/]*$|_test\\.[a-z]+$') as is_test,
  regexp_matches(url, '(?i)(^|/)(node_modules|vendor|dist|build|generated|fixtures|examples?)/|\\.min\\.|\\.d\\.ts$|\\.(lock|snap|map)$') as is_low from pages where url is not null""", graph=False)
def file_predicates(spark, sf_dir):
    return _t(spark, sf_dir, "pages").where("url is not null").select("page_id", facade.is_test(F.col("url")).alias("is_test"), facade.is_low_value(F.col("url")).alias("is_low"))


@query("""select e.src, count(*) as n from edges e join nodes a on a.id = e.src join nodes b on b.id = e.dst where e.kind = 'Contains' and a.kind = b.kind group by 1""")
def same_kind_edges(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    a, b = g.nodes.select(F.col("id").alias("src"), F.col("kind").alias("x")), g.nodes.select(F.col("id").alias("dst"), F.col("kind").alias("y"))
    return g.edges_of_kind("Contains").join(a, "src").join(b, "dst").where("x = y").groupBy("src").agg(F.count("*").alias("n"))


# --- search ---


@query("select id from nodes where kind in ('Function', 'Trait') and contains(lower(file_path), 'nation:1') and contains(lower(name), '00000')")
def filter_axes(spark, sf_dir):
    q = lookup.parse('kind:function kind:Trait path:nation:1 name:"00000"')
    return lookup.filtered(from_tables(spark, sf_dir).nodes, q.filters).select("id")


@query("select id, name, kind, 0.0 as score from nodes where kind = 'Trait' order by name, id limit 15 offset 5")
def filter_only_sweep(spark, sf_dir):
    return lookup.find(from_tables(spark, sf_dir).nodes, "kind:trait", 15, 5)


@query("""with q as (select id, name, kind, lower(name) as low from nodes where kind = 'Module'), t as (select id, list_filter(regexp_split_to_array(low, '[^a-z0-9]+'), lambda x: x <> '') as w from q),
  u as (select id, list_filter(regexp_split_to_array(lower(qualified_name), '[^a-z0-9]+'), lambda x: x <> '') as w from nodes where kind = 'Module'),
  z as (select 10.0 as weight, id, len(w) as l, len(list_filter(w, lambda x: starts_with(x, 'east'))) as tf, 'n' as f from t union all select 5.0, id, len(w), len(list_filter(w, lambda x: starts_with(x, 'east'))), 'q' from u),
  m as (select f, count(*) as n, avg(l) as mean, count(*) filter (where tf > 0) as df from z group by f),
  s as (select id, sum(weight * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) as score from z join m using (f) where tf > 0 group by id)
  select q.id, q.name, q.kind, round(s.score + case when low = 'east' then 80.0 when starts_with(low, 'east') then 60.0 when contains(low, 'east') then 10.0 else 0.0 end + 4.0, 6) as score from q join s using (id)""")
def search_words(spark, sf_dir):
    return lookup.find(from_tables(spark, sf_dir).nodes, "kind:module east", 100)


@query("""select id, name, kind, 0.0 + 10.0 * 0 + round(1.0 / (1 + levenshtein(lower(name), 'eurpe')) + 4.0, 6) as score from nodes where kind = 'Module' and levenshtein(lower(name), 'eurpe') <= 2""")
def search_fuzzy(spark, sf_dir):
    return lookup.find(from_tables(spark, sf_dir).nodes, "kind:module eurpe", 100)


@query("""with f as (select distinct file_path from nodes where lower(name) in ('order_1', 'order_2', 'order_3', 'order_7') group by file_path having count(distinct name) > 1)
  select id, name, case when file_path in (select file_path from f) then 20.0 else 0.0 end as score from nodes where lower(name) in ('order_1', 'order_2', 'order_3', 'order_7')
  union all select * from (select id, name, case when file_path in (select file_path from f) then 20.0 else 0.0 end from nodes where name = 'small ring' order by 3 desc, id limit 20)""")
def exact_names(spark, sf_dir):
    """Four orders, each in its customer's file, and a common name, of which 20 are kept."""
    return lookup.exact_names(from_tables(spark, sf_dir).nodes, ["Order_1", "order_2", "ORDER_3", "order_7", "Small Ring"])


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line from documents where text is not null)
  select doc_id, cast(line as int) as line, content, 'license' as literal from l where contains(lower(content), 'license')""", graph=False)
def literal_lines(spark, sf_dir):
    return lookup.literal_lines(_t(spark, sf_dir, "documents"), "doc_id", "text", ["license"])


# --- structure ---


def _rings(spark, sf_dir):
    """Nations lead to their customers, a customer to its first order of each priority, an order to the customer's next one of that priority, the last one back to the customer."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("next"))
    down = _t(spark, sf_dir, "customer").select(name("nation", "c_nationkey").alias("src"), name("customer", "c_custkey").alias("dst"))
    into = o.select(F.coalesce(name("order", "before"), name("customer", "o_custkey")).alias("src"), name("order", "o_orderkey").alias("dst"))
    back = o.where("next is null").select(name("order", "o_orderkey").alias("src"), name("customer", "o_custkey").alias("dst"))
    return down.unionByName(into).unionByName(back)


_ORDERS = "k as (select o_custkey as c, max('order:' || o_orderkey) as top from orders group by 1), p as (select o_custkey as c, count(*) as n, min('order:' || o_orderkey) as one from orders group by o_custkey, o_orderpriority)"


@query(f"with {_ORDERS} select 'customer:' || c as id from k join customer on c_custkey = c union all select 'nation:' || c_nationkey from customer left join k on c = c_custkey group by c_nationkey having count(*) > 1", graph=False)
def articulation_points(spark, sf_dir):
    return structure.articulation_points(structure.blocks(_rings(spark, sf_dir))).select("id")


@query(f"with {_ORDERS} select 'customer:' || c_custkey as a, 'nation:' || c_nationkey as b from customer union all select 'customer:' || c, one from p where n = 1", graph=False)
def bridges(spark, sf_dir):
    found = structure.bridges(structure.blocks(_rings(spark, sf_dir)))
    x, y = found.columns[:2]
    return found.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


@query(f"with {_ORDERS} select 'nation:' || c_nationkey as a, coalesce(top, 'customer:' || c_custkey) as b from customer left join k on c = c_custkey", graph=False)
def condensation(spark, sf_dir):
    links = _rings(spark, sf_dir)
    parts = traverse.strong_components(links)
    return traverse.condensation(links, parts).select(F.col("src").alias("a"), F.col("dst").alias("b"))


@query("""with o as (select o_orderkey, o_custkey, c_nationkey, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) as k from orders join customer on c_custkey = o_custkey)
  select 'order:' || o_orderkey as target, 'nation:' || c_nationkey as source, k + 1 as hops from o""", graph=False)
def multi_source_paths(spark, sf_dir):
    """From all nations to all orders; a path runs through the orders before."""
    links = _rings(spark, sf_dir)
    ends = lambda kind, c: links.where(F.col(c).startswith(kind)).select(F.col(c).alias("id")).distinct()
    found = paths.nearest_paths(links, ends("nation:", "src"), ends("order:", "dst"))
    return found.select("target", F.col("path")[0].alias("source"), (F.size("path") - 1).cast("long").alias("hops"))


@query("""with o as (select o_custkey, o_orderkey, o_orderstatus as s, lead(o_orderkey) over w as next, lead(o_orderstatus) over w as next_s, row_number() over w as k from orders window w as (partition by o_custkey, o_orderpriority order by o_orderkey))
  select 'order:' || o_orderkey as src, coalesce('order:' || next, 'customer:' || o_custkey) as dst from o where s <> 'P' and coalesce(next_s, '') <> 'P'
  union all select 'customer:' || o_custkey, 'order:' || o_orderkey from o where k = 1 and s <> 'P' union all select 'nation:' || c_nationkey, 'customer:' || c_custkey from customer""", graph=False)
def edges_avoiding(spark, sf_dir):
    """The rings without the orders of one status."""
    gone = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"))
    return paths.avoiding(_rings(spark, sf_dir), gone).select("src", "dst")


@query("select src, dst, kind from edges where kind = 'Contains' and starts_with(src, 'region')")
def filtered_subgraph(spark, sf_dir):
    return from_tables(spark, sf_dir).filtered(F.col("kind") == "Module").edges.select("src", "dst", "kind")


@query("""select c_custkey, case when c_custkey % 4 = 0 then 'new' else c_name end as c_name from customer union all select -1, 'added'""", graph=False)
def overlay_of_branch(spark, sf_dir):
    base = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    changed = base.where("c_custkey % 4 = 0").select("c_custkey", F.lit("new").alias("c_name")).unionByName(spark.createDataFrame([(-1, "added")], "c_custkey long, c_name string"))
    return mining.overlay(base, changed, "c_custkey")


@query("""with t as (select l_suppkey as owner, l_linenumber as member from lineitem where l_quantity >= 49 group by 1, 2), r as (select l_partkey as wanted, l_linenumber as member from lineitem group by 1, 2),
  g as (select owner, wanted, count(*) as k from t join r using (member) group by 1, 2), z as (select wanted, count(*) as n from r group by 1) select owner, wanted from g join z using (wanted) where k = n and owner <> wanted""", graph=False)
def fulfilled_sets(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    asked = li.select(F.col("l_partkey").alias("wanted"), F.col("l_linenumber").alias("member"))
    return channels.fulfilled(asked, li.where("l_quantity >= 49").select(F.col("l_suppkey").alias("owner"), F.col("l_linenumber").alias("member")))


# --- writing ---


@query("""select 'digraph {' as line union all select '}' union all select '  "' || id || '" [label="' || name || '"];' from nodes where kind = 'Module'
  union all select '  "' || src || '" -> "' || dst || '" [label="Contains"];' from edges where kind = 'Contains' and starts_with(src, 'region')""")
def dot_export(spark, sf_dir):
    return store.dot(from_tables(spark, sf_dir).filtered(F.col("kind") == "Module"))


@query("""select id, name from nodes where kind = 'Module' and id <> 'nation:3' and id <> 'nation:4' union all select 'nation:3', 'renamed' union all select 'nation:99', 'new'""")
def upserted_nodes(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    g = PropertyGraph(g.of_kind("Module").where("id <> 'nation:4'"), g.edges)
    row = g.nodes.where("id = 'nation:3'")
    new = row.withColumn("name", F.lit("renamed")).unionByName(row.withColumn("id", F.lit("nation:99")).withColumn("name", F.lit("new")))
    return store.upsert(g, new).nodes.select("id", "name")


@query("select id from nodes where kind = 'Module' and file_path <> 'region:1'")
def deleted_by_file(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    return store.delete_files(PropertyGraph(g.of_kind("Module"), g.edges), spark.createDataFrame([("region:1",)], "file_path string")).nodes.select("id")


@query("""select o_orderkey::varchar as path, case when o_orderkey % 7 = 0 then 'removed' else 'changed' end as change from orders where o_orderkey % 7 = 0 or o_orderkey % 5 = 0 union all select 'x', 'added'""", graph=False)
def changed_files(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_totalprice").cast("string").alias("content_hash"), "o_orderkey")
    now = o.where("o_orderkey % 7 <> 0").select("path", F.when(F.col("o_orderkey") % 5 == 0, "other").otherwise(F.col("content_hash")).alias("content_hash"))
    return store.changed_files(o.select("path", "content_hash"), now.unionByName(spark.createDataFrame([("x", "y")], "path string, content_hash string")))


# --- the query language: operators by themselves, and aggregates over rows ---

dsl("dsl_taint", 'taint("Customer#00000001") | filter kind=Function', _R + "select id from nodes where kind = 'Function' and contains(lower(name), 'customer#00000001') union select e.dst from edges e join nodes n on n.id = e.src where e.kind = 'Calls' and contains(lower(n.name), 'customer#00000001')", "id")
dsl("dsl_since_bare", "since 23950", "select id from nodes where revision >= 23950", "id")
dsl("dsl_affected", "affected 1 since 23977", "with c as (select id from nodes where revision >= 23977) select id from c union select dst from edges join c on src = id union select src from edges join c on dst = id", "id")
dsl("dsl_group_by_file", 'group_by file_path type("Supplier")', "select file_path as key, array_to_string(list_sort(list(id)), ',') as ids from nodes where kind = 'Trait' group by 1")
dsl("dsl_forall_false", 'forall kind=Trait (type("supplier") union fn("order_12"))', "select coalesce(bool_and(kind = 'Trait'), true) as forall from nodes where (kind = 'Trait' and contains(lower(name), 'supplier')) or (kind in ('Struct') and contains(lower(name), 'supplier')) or (kind = 'Function' and contains(lower(name), 'order_12'))")

_plain = QUERIES["dsl_group_by_file"]


def _joined_groups(spark, sf_dir):
    """The members of a group in one text, as the SQL has them: of the suppliers, those of a nation."""
    return _plain(spark, sf_dir).groupBy("key").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))


QUERIES["dsl_group_by_file"] = _joined_groups


@query("select a.kind || '>' || b.kind as pair, count(*) as n from edges e join nodes a on a.id = e.src join nodes b on b.id = e.dst group by 1")
def edge_kinds_between(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    a, b = g.nodes.select(F.col("id").alias("src"), F.col("kind").alias("x")), g.nodes.select(F.col("id").alias("dst"), F.col("kind").alias("y"))
    return g.edges.select("src", "dst").join(a, "src").join(b, "dst").groupBy(F.concat_ws(">", "x", "y").alias("pair")).agg(F.count("*").alias("n"))
