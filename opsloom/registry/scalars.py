"""Queries for scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, net, text, times
from . import views as V
from .core import query, table

_TOK = "regexp_extract_all(replace(replace(text, chr(10), ' '), chr(13), ' '), '([!#$()*,\\-./0-9:=?@A-Z\\[\\]\\^_`a-z{}~]+|[^!#$()*,\\-./0-9:=?@A-Z\\[\\]\\^_`a-z{}~])')"


@query("fn_urlenc", f"""SELECT doc_id, md5(array_to_string(list_transform({_TOK}, lambda r: CASE WHEN regexp_full_match(r, '[!#$()*,\\-./0-9:=?@A-Z\\[\\]\\^_`a-z{{}}~]+')
  THEN r ELSE url_encode(r) END), '')) AS enc FROM documents""")  # fmt: skip
def fn_urlenc(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.url_enc(F.col("text"))).alias("enc"))


@query("fn_urldec", "SELECT page_id, md5(replace(replace(html, chr(10), ' '), chr(13), ' ')) AS dec, url_decode(replace(url, '+', '%2B')) AS url FROM pages")
def fn_urldec(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.md5(text.url_dec(text.url_enc(F.col("html")))).alias("dec"), text.url_dec(F.col("url")).alias("url"))


_HTML = "replace(replace(html, '&', chr(1)), ';', chr(2))"
for _c, _h in (("%", "25"), ("|", "7C"), ("''", "27"), ('"', "22"), ("<", "3C"), (">", "3E"), ("\\", "5C")):
    _HTML = f"replace({_HTML}, '{_c}', '&#x{_h};')"
_HTML = f"replace(replace({_HTML}, chr(1), '&#x26;'), chr(2), '&#x3B;')"


@query("fn_htmlenc", f"SELECT page_id, md5({_HTML}) AS enc FROM pages")
def fn_htmlenc(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.html_enc(F.col("html"))).alias("enc"))


@query("fn_htmldec", "SELECT page_id, md5(html) AS dec FROM pages")
def fn_htmldec(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.html_dec(text.html_enc(F.col("html")))).alias("dec"))


@query("fn_simple", "SELECT doc_id, md5(replace(replace(replace(text, 'e', '\\e'), ';', '\\;'), chr(9), '\\t')) AS enc, md5(text) AS dec FROM documents")
def fn_simple(spark, sf):
    enc = text.simple_enc(F.col("text"), ";e")
    return table(spark, sf, "documents").select("doc_id", F.md5(enc).alias("enc"), F.md5(text.simple_dec(enc, ";e")).alias("dec"))


@query("fn_time_parts", """SELECT event_id, second(ts)::INT AS sec, minute(ts)::INT AS min, hour(ts)::INT AS hour, day(ts)::INT AS mday, (month(ts) - 1)::INT AS mon,
  year(ts)::INT AS year, dayofweek(ts)::INT AS wday, (dayofyear(ts) - 1)::INT AS yday, 0 AS isdst, (epoch_us(ts) % 1000000) * 1000 AS ns FROM events""")  # fmt: skip
def fn_time_parts(spark, sf):
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in times.time_parts(F.col("ts")).items()])


@query("fn_time_parse", """SELECT o_orderkey, epoch_us(CASE o_orderkey % 3 WHEN 0 THEN date_trunc('day', o_orderdate) ELSE o_orderdate END) // 1000000 AS t FROM orders""")
def fn_time_parse(spark, sf):
    d = F.col("o_orderdate")
    forms = [F.date_format(d, f) for f in ("yyyy.MM.dd", "MMM d yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")]
    pick = F.element_at(F.array(*forms), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.unix_timestamp(times.time_parse(pick)).alias("t"))


@query("fn_time_format", "SELECT event_id, strftime(ts, '%Y.%m.%d-%H:%M:%S day %j of %b %y %I%p 100%%') AS s, CAST(epoch_us(ts) // 1000000 AS VARCHAR) AS e FROM events")
def fn_time_format(spark, sf):
    t = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", times.time_format(t, "%Y.%m.%d-%H:%M:%S day %j of %b %y %I%p 100%%").alias("s"), times.time_format(t, "%#").alias("e")
    )


@query("fn_elapsed", """SELECT o_orderkey, ms AS back, CASE WHEN ms >= 86400000 THEN (ms // 86400000) || 'd' ELSE '' END ||
  CASE WHEN ms >= 3600000 THEN printf('%02dh', (ms // 3600000) % 24) ELSE '' END || CASE WHEN ms >= 60000 THEN printf('%02dm', (ms // 60000) % 60) ELSE '' END ||
  printf('%02d.%03ds', (ms // 1000) % 60, ms % 1000) AS txt FROM (SELECT o_orderkey, (o_orderkey * 7919) % 200000000 AS ms FROM orders)""")  # fmt: skip
def fn_elapsed(spark, sf):
    ms = F.expr("(o_orderkey * 7919) % 200000000")
    txt = times.elapsed_format(ms)
    return table(spark, sf, "orders").select("o_orderkey", txt.alias("txt"), times.elapsed_parse(txt).alias("back"))


@query("fn_ip", f"""WITH {V.FLOW} SELECT orderkey, linenumber, (src >> 24) || '.' || ((src >> 16) & 255) || '.' || ((src >> 8) & 255) || '.' || (src & 255) AS txt,
  src AS back, src - src % 4096 AS net, src - src % 4096 + 4095 AS last FROM flow""")  # fmt: skip
def fn_ip(spark, sf):
    a = F.col("src")
    txt = net.ip_format(a)
    n = F.lit(20)
    return V.flow(spark, sf).select(
        "orderkey", "linenumber", txt.alias("txt"), net.ip_parse(txt).alias("back"), net.network(a, n).alias("net"),
        net.broadcast_address(a, n).alias("last"),
    )


@query("fn_prefix_parse", f"WITH {V.PFX_A} SELECT owner, addr, len, 4294967296 - (1::BIGINT << (32 - len)) AS mask FROM pa")
def fn_prefix_parse(spark, sf):
    p = V.prefix_table(spark, sf)
    parsed = net.prefix_parse(F.concat_ws("/", net.ip_format(F.col("addr")), "len"))
    return p.select("owner", parsed.alias("p")).select("owner", "p.addr", "p.len", net.mask(F.col("p.len")).alias("mask"))


@query("fn_ip6", f"""WITH {V.FLOW} SELECT orderkey, linenumber, '00000000000000000000ffff' || printf('%08x', src) AS hex FROM flow""")
def fn_ip6(spark, sf):
    b = net.ip6_parse(net.ip6_format(net.ip6_parse(net.ip_format(F.col("src")))))
    return V.flow(spark, sf).select("orderkey", "linenumber", F.lower(F.hex(b)).alias("hex"))


@query("fn_aspath", """SELECT l_orderkey, l_linenumber, l_orderkey % 9 AS origin, 4 AS hops, (l_suppkey % 7 = 3 OR l_partkey % 5 = 3 OR l_orderkey % 9 = 3) AS has3 FROM lineitem""")
def fn_aspath(spark, sf):
    li = table(spark, sf, "lineitem")
    p = net.aspath_parse(F.format_string("%d {%d,%d} %d", F.expr("l_suppkey % 7"), F.expr("l_partkey % 5"), F.expr("l_partkey % 5"), F.expr("l_orderkey % 9")))
    return li.select("l_orderkey", "l_linenumber", p.alias("p")).select(
        "l_orderkey", "l_linenumber", net.aspath_origin(F.col("p")).alias("origin"), F.size("p").alias("hops"),
        F.array_contains("p", F.lit(3).cast("bigint")).alias("has3"),
    )


_FLAG = " || ".join(f"CASE WHEN tcp_flags & {b} <> 0 THEN '|{n}' ELSE '' END" for b, n in codes.TCP_FLAGS.items())


@query("fn_value_map", f"""WITH {V.FLOW} SELECT orderkey, linenumber, CASE protocol WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' END AS proto, protocol AS back,
  ltrim({_FLAG}, '|') AS flags, tcp_flags AS bits, (tcp_flags >> 2) & 3 AS part FROM flow""")  # fmt: skip
def fn_value_map(spark, sf):
    f = V.flow(spark, sf)
    name = codes.code_name(F.col("protocol"), codes.PROTOCOLS)
    flags = codes.flag_names(F.col("tcp_flags"), codes.TCP_FLAGS)
    part = codes.code_name(F.col("tcp_flags"), {i: str(i) for i in range(4)}, shift=2, mask=3)
    return f.select(
        "orderkey", "linenumber", name.alias("proto"), codes.name_code(F.upper(name), codes.PROTOCOLS, True).alias("back"),
        flags.alias("flags"), codes.flags_code(flags, codes.TCP_FLAGS).alias("bits"), part.cast("int").alias("part"),
    )


@query("fn_map_edit", r"SELECT c_custkey, regexp_replace(regexp_replace(c_name, '#0*', '-'), '^Customer', 'cust') AS name FROM customer")
def fn_map_edit(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.map_edit(F.col("c_name"), [("#0*", "-"), ("^Customer", "cust")]).alias("name"))


@query("fn_html_ref", r"SELECT page_id, regexp_extract(html, '(?is)<a\b[^>]*>(.*?)</a>', 1) AS ref, regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1) AS title FROM pages")
def fn_html_ref(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", text.html_ref(F.col("html")).alias("ref"), text.html_ref(F.col("html"), "title").alias("title")
    )


@query("fn_cut", """SELECT o_orderkey, substring(o_orderpriority, 1, 1) || ':' || substring(o_orderpriority, 3, 3) || CASE WHEN length(o_orderpriority) >= 7 THEN ':' || substring(o_orderpriority, 7) ELSE '' END AS chars,
  split_part(s, ',', 1) || ';' || split_part(s, ',', 3) || ';' || split_part(s, ',', 4) AS fields, CASE WHEN contains(o_orderpriority, ' ') THEN split_part(o_orderpriority, ' ', 2) END AS only
  FROM (SELECT *, o_orderkey || ',' || o_custkey || ',' || o_orderstatus || ',x' AS s FROM orders)""")  # fmt: skip
def fn_cut(spark, sf):
    o = table(spark, sf, "orders")
    p = F.col("o_orderpriority")
    line = F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus", F.lit("x"))
    return o.select(
        "o_orderkey", text.cut_chars(p, "7-,1,3-5", ":").alias("chars"), text.cut_fields(line, "3-4,1", ",", ";").alias("fields"),
        text.cut_fields(p, "2", " ", only_delimited=True).alias("only"),
    )


@query("fn_tr", r"""SELECT p_partkey, translate(p_name, 'abcde', 'ABCDD') AS up, regexp_replace(p_name, '[aeiou]', '', 'g') AS del,
  regexp_replace(p_name, '[^a-z]', '_', 'g') AS comp FROM part""")  # fmt: skip
def fn_tr(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").select(
        "p_partkey", text.tr(n, "a-e", "A-D").alias("up"), text.tr(n, "aeiou", delete=True).alias("del"),
        text.tr(n, "a-z", "_", complement=True).alias("comp"),
    )


@query("fn_tr_squeeze", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, 'e+', 'e', 'g'), 'l+', 'l', 'g')) AS h FROM documents")
def fn_tr_squeeze(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.tr(F.col("text"), "el", squeeze=True)).alias("h"))


@query("fn_fold", """WITH f AS (SELECT conv_id, turn, flatten(list_transform(string_split(text, chr(10)), lambda l: list_transform(range(greatest(CAST(ceil(length(l) / 40.0) AS BIGINT), 1)),
  lambda i: substring(l, i * 40 + 1, 40)))) AS ls FROM conversations) SELECT conv_id, turn, CAST(unnest(range(len(ls))) AS INTEGER) AS i, unnest(ls) AS line FROM f""")  # fmt: skip
def fn_fold(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.posexplode(text.fold(F.col("text"), 40)).alias("i", "line"))


@query("fn_fold_blanks", r"""WITH f AS (SELECT conv_id, turn, flatten(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN l = '' THEN [''] ELSE
  regexp_extract_all(l, '(.{1,40}\z|.{0,39}[ \t]|.{1,40})') END)) AS ls FROM conversations) SELECT conv_id, turn, len(ls) AS n, md5(array_to_string(ls, '/')) AS h FROM f""")  # fmt: skip
def fn_fold_blanks(spark, sf):
    f = text.fold(F.col("text"), 40, at_blanks=True)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(f).cast("bigint").alias("n"), F.md5(F.array_join(f, "/")).alias("h"))


@query("fn_checksum", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1 FROM documents")
def fn_checksum(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *[text.checksum(F.col("text"), m).alias(m) for m in ("md5", "sha1")])


@query("fn_checksum_crc", """SELECT c_custkey, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c_name) + 1), lambda i: ord(c_name[i])::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) AS crc FROM customer""")  # fmt: skip
def fn_checksum_crc(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.checksum(F.col("c_name"), "crc").alias("crc"))


@query("fn_template", f"""WITH {V.NODES}, {V.CLOSURE}, nm AS (SELECT level, id, val FROM inv_node WHERE key = 'name'),
  r AS (SELECT c.id1, n.val FROM closure c JOIN nm n ON n.level = c.level2 AND n.id = c.id2 WHERE c.level1 = 'n' AND c.level2 = 'r'),
  s AS (SELECT m.id2 AS id, n.val, row_number() OVER (PARTITION BY m.id2 ORDER BY n.val) AS k FROM inv_map m JOIN nm n ON n.level = 's' AND n.id = m.id1 WHERE m.level1 = 's'),
  sx AS (SELECT id, string_agg(val, chr(10) ORDER BY val) FILTER (k <= 3) || CASE WHEN count(*) > 3 THEN ' ...' ELSE '' END AS t FROM s GROUP BY id)
  SELECT n.id, 'Nation ' || n.val || ' in ' || r.val || ' served by ' || coalesce(sx.t, n.id) AS text FROM nm n JOIN r ON r.id1 = n.id LEFT JOIN sx ON sx.id = n.id WHERE n.level = 'n'""")  # fmt: skip
def fn_template(spark, sf):
    nodes, m = V.inv_node(spark, sf), V.inv_map(spark, sf)
    down = m.where("level1 = 's'").selectExpr("level2 as level1", "id2 as id1", "level1 as level2", "id1 as id2")
    up = m.where("level1 = 'n'").select(*down.columns)
    assets = nodes.where("level = 'n'").select("level", "id").distinct()
    out = text.template_text(assets, up.unionByName(down), nodes, "Nation %(name)% in %(r.name)% served by %(x.name/s.name)%")
    return out.select("id", "text")


@query("fn_vars_unpack", f"""WITH {V.ALARMS} SELECT seq, split_part(split_part(variables, chr(9) || chr(9), 1), '=', 2) AS k, id1 AS u FROM alarm""")
def fn_vars_unpack(spark, sf):
    v = text.vars_unpack(F.col("variables"))
    return V.alarm(spark, sf).select("seq", F.try_element_at(v, F.lit("k")).alias("k"), F.try_element_at(v, F.lit("u")).alias("u"))


@query("fn_json_path", "SELECT event_id, props ->> '$.k' AS k, props ->> '$.a.b' AS missing FROM events")
def fn_json_path(spark, sf):
    p = F.col("props")
    return table(spark, sf, "events").select("event_id", text.json_path(p, "k").alias("k"), text.json_path(p, "a.b").alias("missing"))
