"""Queries on scalar functions: text, dates, numbers, lists, maps, JSON, vectors, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import collections as lists
from tarn.functions import dates, inet, json, numbers, search, text
from tarn.plans.registry import Tables, query


@query("SELECT p_partkey, upper(p_name) u, length(p_name) n, p_name[2:5] sl, left(p_name,4) l, left(p_name,-3) lm, right(p_name,3) r, reverse(p_brand) rv, repeat('ab',p_size%3) rp, lpad(p_brand,12,'*') lp, rpad(p_brand,3,'x') rd, instr(p_name,'a') ix, replace(p_name,'a','_') rc, translate(p_name,'abc','xyz') tr, trim(p_brand,'B#') tm, ascii(p_name) ac, chr(65+p_size%26) ch FROM part")
def strings_basic(t: Tables) -> DataFrame:
    n, b = F.col("p_name"), F.col("p_brand")
    return t.part.select(
        "p_partkey", F.upper(n).alias("u"), F.length(n).cast("long").alias("n"), text.array_slice(n, 2, 5).alias("sl"),
        text.left(n, 4).alias("l"), text.left(n, -3).alias("lm"), text.right(n, 3).alias("r"), F.reverse(b).alias("rv"),
        F.expr("repeat('ab', p_size % 3)").alias("rp"), F.lpad(b, 12, "*").alias("lp"), F.rpad(b, 3, "x").alias("rd"),
        F.instr(n, "a").cast("long").alias("ix"), F.replace(n, F.lit("a"), F.lit("_")).alias("rc"),
        F.translate(n, "abc", "xyz").alias("tr"), F.btrim(b, F.lit("B#")).alias("tm"), F.ascii(n).alias("ac"),
        F.expr("char(65 + p_size % 26)").alias("ch"),
    )


@query("SELECT c_custkey, concat(c_name, NULL, '-', c_mktsegment) c, c_name || '/' || c_mktsegment o, concat_ws('|', c_name, NULL, c_mktsegment) w, contains(c_name,'00') ct, starts_with(c_name,'Cust') sw, suffix(c_name,'9') sf, split_part(c_name,'#',2) sp, string_split(c_name,'0')[1] s1, format('{}:{}', c_custkey, c_mktsegment) f, printf('%05d', c_custkey) p FROM customer")
def strings_concat_and_search(t: Tables) -> DataFrame:
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey", text.concat(n, F.lit(None), F.lit("-"), m).alias("c"), F.concat(n, F.lit("/"), m).alias("o"),
        F.concat_ws("|", n, F.lit(None), m).alias("w"), F.contains(n, F.lit("00")).alias("ct"),
        F.startswith(n, F.lit("Cust")).alias("sw"), F.endswith(n, F.lit("9")).alias("sf"),
        F.split_part(n, F.lit("#"), F.lit(2)).alias("sp"), F.get(text.split_literal(n, "0"), F.lit(0)).alias("s1"),
        F.concat(F.col("c_custkey").cast("string"), F.lit(":"), m).alias("f"), F.format_string("%05d", "c_custkey").alias("p"),
    )


@query("SELECT doc_id, regexp_matches(text,'the [a-z]+ing') m, regexp_extract(text,'([a-z]+)ing',1) e, regexp_replace(text,'[aeiou]','#') r1, md5(regexp_replace(text,'[aeiou]','#','g')) rg, regexp_full_match(lang,'e[ns]') fm, CAST(len(regexp_extract_all(text,'[0-9]+')) AS BIGINT) xa, len(string_split_regex(text,'[ ]+')) sr, lang GLOB 'e*' g, lang SIMILAR TO '(en|fr)' st, lang ILIKE 'E_' il FROM documents")
def regular_expressions(t: Tables) -> DataFrame:
    x, g = F.col("text"), F.col("lang")
    return t.documents.select(
        "doc_id", x.rlike("the [a-z]+ing").alias("m"), F.regexp_extract(x, "([a-z]+)ing", 1).alias("e"),
        text.regexp_replace_first(x, "[aeiou]", "#").alias("r1"), F.md5(F.regexp_replace(x, "[aeiou]", "#")).alias("rg"),
        text.regexp_full_match(g, "e[ns]").alias("fm"),
        F.size(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0))).cast("long").alias("xa"),
        F.size(F.split(x, "[ ]+", -1)).cast("long").alias("sr"), text.glob(g, "e*").alias("g"),
        text.regexp_full_match(g, "en|fr").alias("st"), g.ilike("E_").alias("il"),
    )


@query("SELECT p_partkey, md5(p_name) m, sha256(p_name) s, lower(hex(p_brand)) h, to_base64(encode(p_name)) b, decode(from_base64(to_base64(encode(p_name)))) d, bin(p_size) bn, hex(p_size) hx, format_bytes(0) fb, levenshtein(p_name,p_brand) lv, hamming(left(p_name,3),left(p_brand,3)) hm, round(jaccard(p_name,p_brand),6) jc, bit_length(p_name) bl, strlen(p_name) sl FROM part WHERE length(p_name)>3")
def strings_encoding_and_distance(t: Tables) -> DataFrame:
    n, b = F.col("p_name"), F.col("p_brand")
    return t.part.where("length(p_name) > 3").select(
        "p_partkey", F.md5(n).alias("m"), F.sha2(n, 256).alias("s"), F.lower(F.hex(b)).alias("h"), F.base64(F.encode(n, "UTF-8")).alias("b"),
        F.decode(F.unbase64(F.base64(F.encode(n, "UTF-8"))), "UTF-8").alias("d"), F.bin("p_size").alias("bn"), F.hex("p_size").alias("hx"),
        text.format_bytes(F.lit(0)).alias("fb"), F.levenshtein(n, b).cast("long").alias("lv"),
        text.hamming(text.left(n, 3), text.left(b, 3)).alias("hm"), F.round(text.jaccard(n, b), 6).alias("jc"),
        F.bit_length(n).cast("long").alias("bl"), F.octet_length(n).cast("long").alias("sl"),
    )


@query("SELECT p_partkey, round(jaro_similarity(p_name,p_type),6) j, round(jaro_winkler_similarity(p_name,p_type),6) jw, damerau_levenshtein(p_name,p_type) dl, strip_accents(p_name || 'éü') sa, nfc_normalize(p_name) nf FROM part")
def strings_similarity(t: Tables) -> DataFrame:
    a, b = F.col("p_name"), F.col("p_type")
    return t.part.select(
        "p_partkey", F.round(text.jaro_similarity(a, b), 6).alias("j"), F.round(text.jaro_winkler_similarity(a, b), 6).alias("jw"),
        text.damerau_levenshtein(a, b).alias("dl"), text.strip_accents(F.concat(a, F.lit("éü"))).alias("sa"), text.nfc_normalize(a).alias("nf"),
    )


@query("SELECT page_id, parse_filename(url) f, parse_filename(url,true) ft, parse_dirname(url) d, parse_dirpath(url) p FROM pages")
def strings_paths(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select(
        "page_id", text.parse_filename(u).alias("f"), text.parse_filename(u, True).alias("ft"), text.parse_dirname(u).alias("d"),
        text.parse_dirpath(u).alias("p"),
    )


@query("SELECT event_id, year(ts) y, quarter(ts) q, month(ts) m, day(ts) d, dayofweek(ts) dw, isodow(ts) iw, dayofyear(ts) dy, weekofyear(ts) wk, yearweek(ts) yw, hour(ts) h, century(ts) c, decade(ts) de, millennium(ts) ml, epoch_us(ts) eu, monthname(ts) mn, dayname(ts) dn, last_day(ts) ld FROM events")
def date_parts(t: Tables) -> DataFrame:
    x = F.col("ts")
    long = lambda c, n: c.cast("long").alias(n)
    return t.events.select(
        "event_id", long(F.year(x), "y"), long(F.quarter(x), "q"), long(F.month(x), "m"), long(F.dayofmonth(x), "d"),
        dates.dow(x).alias("dw"), dates.isodow(x).alias("iw"), long(F.dayofyear(x), "dy"), long(F.weekofyear(x), "wk"),
        dates.yearweek(x).alias("yw"), long(F.hour(x), "h"), dates.century(x).alias("c"), dates.decade(x).alias("de"),
        dates.millennium(x).alias("ml"), dates.micros(x).alias("eu"),
        F.date_format(x, "MMMM").alias("mn"), F.date_format(x, "EEEE").alias("dn"), F.last_day(x).alias("ld"),
    )


@query("SELECT o_orderkey, date_trunc('week',o_orderdate) w, date_trunc('month',o_orderdate) m, date_trunc('quarter',o_orderdate) q, date_trunc('decade',o_orderdate) d, time_bucket(INTERVAL '10 days',o_orderdate) b, time_bucket(INTERVAL '3 months',o_orderdate) bm, o_orderdate + INTERVAL 1 MONTH pm, o_orderdate - INTERVAL 36 HOUR mh FROM orders")
def date_truncation_and_buckets(t: Tables) -> DataFrame:
    x = F.col("o_orderdate")
    ntz = lambda c, n: c.cast("timestamp_ntz").alias(n)
    return t.orders.select(
        "o_orderkey", ntz(dates.date_trunc("week", x), "w"), ntz(dates.date_trunc("month", x), "m"), ntz(dates.date_trunc("quarter", x), "q"),
        ntz(dates.date_trunc("decade", x), "d"), dates.time_bucket(x, 10, "day").alias("b"), dates.time_bucket(x, 3, "month").alias("bm"),
        (x + F.expr("INTERVAL 1 MONTH")).alias("pm"), (x - F.expr("INTERVAL 36 HOURS")).alias("mh"),
    )


@query("SELECT l_orderkey, l_linenumber, date_diff('month',o_orderdate,l_shipdate) m, date_diff('week',o_orderdate,l_shipdate) w, date_diff('day',o_orderdate,l_shipdate) d, date_diff('year',o_orderdate,l_shipdate) y, date_sub('month',o_orderdate,l_shipdate) sm, date_sub('day',o_orderdate,l_shipdate) sd, date_sub('year',o_orderdate,l_shipdate) sy FROM lineitem JOIN orders ON l_orderkey=o_orderkey")
def date_differences(t: Tables) -> DataFrame:
    a, b = F.col("o_orderdate"), F.col("l_shipdate")
    return t.lineitem.join(t.orders, F.expr("l_orderkey = o_orderkey")).select(
        "l_orderkey", "l_linenumber", dates.date_diff("month", a, b).alias("m"), dates.date_diff("week", a, b).alias("w"),
        dates.date_diff("day", a, b).alias("d"), dates.date_diff("year", a, b).alias("y"), dates.date_sub("month", a, b).alias("sm"),
        dates.date_sub("day", a, b).alias("sd"), dates.date_sub("year", a, b).alias("sy"),
    )


@query("SELECT event_id, strftime(ts,'%Y/%m/%d at %H-%M') f, strptime(strftime(ts,'%Y-%m-%d %H:%M:%S'),'%Y-%m-%d %H:%M:%S') p, try_strptime('no','%Y') n, make_date(year(ts),month(ts),1) md, make_timestamp(epoch_us(ts)) mt FROM events")
def date_formats(t: Tables) -> DataFrame:
    x = F.col("ts")
    return t.events.select(
        "event_id", dates.strftime(x, "%Y/%m/%d at %H-%M").alias("f"),
        dates.strptime(dates.strftime(x, "%Y-%m-%d %H:%M:%S"), "%Y-%m-%d %H:%M:%S").alias("p"), dates.try_strptime(F.lit("no"), "%Y").alias("n"),
        F.make_date(F.year(x), F.month(x), F.lit(1)).alias("md"), dates.from_micros(dates.micros(x)).alias("mt"),
    )


@query("SELECT p_partkey, abs(-p_size) a, round(pow(p_size,1.5),6) p, factorial(p_size%15)::BIGINT f, round(cbrt(p_size),9) c, ceil(p_retailprice) ce, floor(p_retailprice) fl, even(p_retailprice) e, round(ln(p_size),9) l, round(log2(p_size),9) l2, round(log(p_size),9) l10, sign(p_size-20)::INT s, trunc(p_retailprice) t, gcd(p_partkey,p_size)::BIGINT g, lcm(p_size,12)::BIGINT lc, round(degrees(p_size),6) dg, round(atan2(p_size,3),9) a2, round(gamma(p_size%10+1),3) gm, round(lgamma(p_size),6) lg, p_partkey // p_size id, p_partkey % p_size mo, p_size & 12 ba, p_size | 3 bo, xor(p_size,5) bx, p_size << 2 sh, bit_count(p_size)::INT bc, round(sin(p_size)+cos(p_size)+tan(p_size),6) tg FROM part")
def numbers_math(t: Tables) -> DataFrame:
    k, s, r = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    return t.part.select(
        "p_partkey", F.abs(-s).alias("a"), F.round(F.pow(s, F.lit(1.5)), 6).alias("p"), F.factorial(s % 15).alias("f"), F.round(F.cbrt(s), 9).alias("c"),
        F.ceil(r).cast("double").alias("ce"), F.floor(r).cast("double").alias("fl"), numbers.even(r).alias("e"), F.round(F.ln(s), 9).alias("l"),
        F.round(F.log2(s), 9).alias("l2"), F.round(numbers.log(s), 9).alias("l10"), F.signum(s - 20).cast("int").alias("s"), numbers.trunc(r).alias("t"),
        numbers.gcd(k, s).alias("g"), numbers.lcm(s, F.lit(12)).alias("lc"), F.round(F.degrees(s), 6).alias("dg"), F.round(F.atan2(s, F.lit(3)), 9).alias("a2"),
        F.round(numbers.gamma((s % 10 + 1).cast("double")), 3).alias("gm"), F.round(numbers.lgamma(s.cast("double")), 6).alias("lg"),
        F.expr("p_partkey div p_size").alias("id"), (k % s).alias("mo"), s.bitwiseAND(12).alias("ba"), s.bitwiseOR(3).alias("bo"), s.bitwiseXOR(5).alias("bx"),
        F.shiftleft(s, 2).alias("sh"), F.bit_count(s).alias("bc"), F.round(F.sin(s) + F.cos(s) + F.tan(s), 6).alias("tg"),
    )


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[],b.embedding::DOUBLE[]),5) c, round(list_distance(a.embedding::DOUBLE[],b.embedding::DOUBLE[]),4) d, round(list_inner_product(a.embedding::DOUBLE[],b.embedding::DOUBLE[]),4) i FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1")
def vector_distances(t: Tables) -> DataFrame:
    a = t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = t.embeddings.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, F.expr("b = a + 1")).select(
        "a", "b", F.round(lists.cosine_similarity(x, y), 5).alias("c"), F.round(lists.distance(x, y), 4).alias("d"),
        F.round(lists.inner_product(x, y), 4).alias("i"),
    )


@query("""WITH l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) ps FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(ps) n, ps[1] f, ps[-1] la, list_contains(ps,ps[1]) c, list_position(ps,ps[-1])::BIGINT po, list_sum(ps)::BIGINT s, round(list_avg(ps),6) av, list_min(ps) mi, list_max(ps) ma, len(list_distinct(ps)) di, list_unique(ps)::BIGINT un,
list_sort(ps)[1] so, list_reverse_sort(ps)[1] rs, list_grade_up(ps)[1] gu, list_reduce(ps,lambda a,b: a+b) re, list_sum(list_transform(list_filter(ps,lambda x: x%2=0),lambda x: x*2))::BIGINT tf, list_slice(ps,1,2)[2] sl, array_to_string(list_slice(ps,1,5,2),'-') st, array_to_string(list_concat(ps,NULL,[7]),',') cc, array_to_string(list_resize(ps,3,0),',') rz, array_to_string(flatten([ps,[1]]),',') ft, list_has_any(ps,[1,2,3]) ha FROM l""")
def list_functions(t: Tables) -> DataFrame:
    from tarn.operators import aggregates as agg

    own = t.lineitem.groupBy("l_orderkey").agg(agg.ordered_list(F.col("l_partkey"), F.col("l_linenumber")).alias("ps"))
    p = F.col("ps")
    long = lambda c, n: c.cast("long").alias(n)
    joined = lambda c, n, by=",": F.array_join(c.cast("array<string>"), by).alias(n)
    seven = F.array(F.lit(7).cast("long"))
    own, s = own.withColumn("ordered", F.array_sort(p)), F.col("ordered")  # sorted once
    return own.select(
        "l_orderkey", long(F.size(p), "n"), lists.extract(p, 1).alias("f"), lists.extract(p, -1).alias("la"), F.array_contains(p, F.get(p, F.lit(0))).alias("c"),
        long(F.array_position(p, lists.extract(p, -1)), "po"), lists.total(p, "long").alias("s"), F.round(lists.mean(p), 6).alias("av"),
        F.array_min(p).alias("mi"), F.array_max(p).alias("ma"), long(F.size(lists.distinct(p)), "di"), lists.unique(p).alias("un"),
        F.get(s, F.lit(0)).alias("so"), lists.extract(s, -1).alias("rs"), F.get(lists.grade_up(p), F.lit(0)).alias("gu"),
        lists.reduce(p, lambda a, b: a + b).alias("re"),
        lists.total(F.transform(F.filter(p, lambda x: x % 2 == 0), lambda x: x * 2), "long").alias("tf"), lists.extract(F.slice(p, 1, 2), 2).alias("sl"),
        joined(lists.slice_step(p, 1, 5, 2), "st", "-"), joined(lists.concat_lists(lists.concat_lists(p, F.lit(None).cast("array<bigint>")), seven), "cc"),
        joined(lists.resize(p, 3, F.lit(0).cast("long")), "rz"), joined(F.flatten(F.array(p, F.array(F.lit(1).cast("long")))), "ft"),
        F.arrays_overlap(p, F.array(*(F.lit(i).cast("long") for i in (1, 2, 3)))).alias("ha"),
    )


@query("SELECT o_custkey, unnest(list(o_orderkey ORDER BY o_orderkey)) k FROM orders GROUP BY 1")
def unnest(t: Tables) -> DataFrame:
    o = t.orders
    own = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ks"))
    return own.select("o_custkey", F.explode("ks").alias("k"))


@query("""WITH m AS (SELECT n_regionkey, map_from_entries(list((n_name, n_nationkey) ORDER BY n_name)) m FROM nation GROUP BY 1)
SELECT n_regionkey, cardinality(m)::BIGINT c, array_to_string(list_sort(map_keys(m)),',') k, list_sum(map_values(m))::BIGINT v, m['CHINA'] e, map_concat(m, MAP {'x': 1::INTEGER})['x'] x FROM m""")
def map_functions(t: Tables) -> DataFrame:
    m = F.col("m")
    own = t.nation.groupBy("n_regionkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey")))).alias("m"))
    return own.select(
        "n_regionkey", F.size(m).cast("long").alias("c"), F.array_join(F.array_sort(F.map_keys(m)), ",").alias("k"), lists.total(F.map_values(m), "long").alias("v"),
        F.try_element_at(m, F.lit("CHINA")).alias("e"), F.map_concat(m, F.create_map(F.lit("x"), F.lit(1)))["x"].alias("x"),
    )


@query("SELECT c_custkey, struct_extract(s,'seg') seg, s.bal b, enum_code(c_mktsegment::ENUM('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'))::INT e, get_bit('10110'::BIT, (c_custkey%5)::INT) gb, set_bit('10110'::BIT,1,1)::VARCHAR sb, bit_position('11'::BIT,'10110'::BIT) bp FROM (SELECT *, {'seg': c_mktsegment, 'bal': c_acctbal} s FROM customer)")
def struct_enum_and_bits(t: Tables) -> DataFrame:
    kinds = lists.Enum("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    own = t.customer.withColumn("s", F.struct(F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal")))
    return own.select(
        "c_custkey", F.col("s.seg").alias("seg"), F.col("s.bal").alias("b"), kinds.code(F.col("c_mktsegment")).alias("e"),
        F.expr("CAST(substring('10110', CAST(c_custkey % 5 AS INT) + 1, 1) AS INT)").alias("gb"), lists.set_bit(F.lit("10110"), 1, 1).alias("sb"),
        lists.bit_position(F.lit("11"), F.lit("10110")).alias("bp"),
    )


@query("SELECT event_id, props->>'$.k' k, json_valid(props) v, CAST(len(json_keys(props)) AS BIGINT) n, json_type(props) ty, CAST(json_array_length('[1,2,3]') AS BIGINT) al FROM events")
def json_functions(t: Tables) -> DataFrame:
    p = F.col("props")
    return t.events.select(
        "event_id", json.extract_string(p, "$.k").alias("k"), json.valid(p).alias("v"), F.size(json.keys(p)).cast("long").alias("n"),
        F.when(p.startswith("{"), "OBJECT").alias("ty"), json.array_length(F.lit("[1,2,3]")).alias("al"),
    )


@query("SELECT event_id, json_merge_patch(props, '{\"z\":1,\"k\":null}')::VARCHAR m, json_contains(props, '{}') c FROM events")
def json_patch_and_contains(t: Tables) -> DataFrame:
    e = t.events
    return e.select(
        "event_id", json.merge_patch(F.col("props"), F.lit('{"z":1,"k":null}')).alias("m"), json.contains(F.col("props"), F.lit("{}")).alias("c")
    )


@query()
def inet_functions(t: Tables) -> DataFrame:
    a = F.concat(F.lit("10.0."), F.expr("c_custkey % 256"), F.lit(".7/16"))
    own = t.customer.select("c_custkey", a.alias("a"))
    return own.select(
        "c_custkey", inet.host("a").alias("host"), inet.family("a").alias("family"), inet.netmask("a").alias("mask"), inet.add("a", F.lit(300)).alias("later")
    )


@query("""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text),'[^a-z0-9]+'), lambda x: x<>'')) term FROM documents),
l AS (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text),'[^a-z0-9]+'), lambda x: x<>'')) n FROM documents),
p AS (SELECT doc_id, term, count(*) tf FROM w WHERE term IN ('the','thing','ention') GROUP BY ALL), d AS (SELECT term, count(*) df FROM p GROUP BY 1), g AS (SELECT count(*) docs, avg(n) mean FROM l)
SELECT p.doc_id AS id, round(sum(ln((docs-df+0.5)/(df+0.5)+1) * tf*2.2/(tf+1.2*(1-0.75+0.75*n/mean))),6) AS score FROM p JOIN d USING (term) JOIN l USING (doc_id), g GROUP BY 1""")
def full_text_bm25(t: Tables) -> DataFrame:
    found = search.match_bm25(t.documents, "The thing, ention", "doc_id", "text")
    return found.select("id", F.round("score", 6).alias("score"))


@query("SELECT time_bucket(INTERVAL '6 hours', ts) b, event_type, count(*) n, round(sum(value),3) s FROM events GROUP BY ALL")
def tumbling_window(t: Tables) -> DataFrame:
    return t.events.groupBy(dates.time_bucket(F.col("ts"), 6, "hour").alias("b"), "event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("s")
    )


@query("WITH w AS (SELECT unnest(generate_series(time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes', time_bucket(INTERVAL '30 minutes', ts), INTERVAL '30 minutes')) b, value FROM events) SELECT b, count(*) n FROM w GROUP BY 1")
def sliding_window(t: Tables) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "1 hour", "30 minutes")
    return t.events.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("b"), "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '30 minutes' THEN 0 ELSE 1 END f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) sid FROM g) SELECT user_id, min(ts) b, max(ts) e, count(*) n FROM s GROUP BY user_id, sid""")
def session_window(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = dates.micros(F.col("ts"))
    gap = F.when(us - F.lag(us).over(w) <= 30 * dates.FIXED["minute"], 0).otherwise(1)
    s = t.events.withColumn("f", gap).withColumn("sid", F.sum("f").over(w))
    return s.groupBy("user_id", "sid").agg(F.min("ts").alias("b"), F.max("ts").alias("e"), F.count("*").alias("n")).drop("sid")
