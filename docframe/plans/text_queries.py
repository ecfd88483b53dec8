"""String, number and object methods."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.functions import strings as S
from docframe.functions import values as V
from docframe.operators import order
from docframe.plans.registry import query


@query("SELECT doc_id, length(text) AS n, upper(lang) AS up, lower(upper(source)) AS low FROM documents")
def text_length_case(t):
    """T1, T2."""
    return t("documents").select("doc_id", S.length(F.col("text")).alias("n"), S.upper(F.col("lang")).alias("up"), S.lower(S.upper(F.col("source"))).alias("low"))


@query(r"SELECT doc_id, regexp_replace(chr(9) || text || '  ', '^\s+|\s+$', '', 'g') AS trimmed, regexp_replace(chr(9) || lang || ' ', '^\s+', '') AS start_trimmed, regexp_replace(chr(10) || lang || ' ', '\s+$', '') AS end_trimmed FROM documents")
def text_trim(t):
    """T3."""
    return t("documents").select(
        "doc_id", S.trim(F.concat(F.lit("\t"), "text", F.lit("  "))).alias("trimmed"), S.trim_start(F.concat(F.lit("\t"), "lang", F.lit(" "))).alias("start_trimmed"), S.trim_end(F.concat(F.lit("\n"), "lang", F.lit(" "))).alias("end_trimmed")
    )


@query("SELECT item_id, substring(text, 3, 5) AS a, right(text, 7) AS b, left(right(text, 7), 4) AS c, substring(text, 3, 6) AS d, left(text, 4) AS e FROM benchmark")
def text_slice(t):
    """T4, T5: slice(2,7), slice(-7), slice(-7,-3), substring(8,2), substring(-3,4)."""
    x = F.col("text")
    return t("benchmark").select("item_id", S.slice_text(x, 2, 7).alias("a"), S.slice_text(x, -7).alias("b"), S.slice_text(x, -7, -3).alias("c"), S.substring(x, 8, 2).alias("d"), S.substring(x, -3, 4).alias("e"))


@query("SELECT doc_id, CASE WHEN instr(text, 'the') > 0 THEN left(text, instr(text, 'the') - 1) || '<>' || substring(text, instr(text, 'the') + 3) ELSE text END AS first, replace(text, 'the', '<>') AS every, regexp_replace(text, '[aeiou]{2}', '_', 'g') AS matches, regexp_replace(text, '([a-z])n', '\\1-n') AS group_first FROM documents")
def text_replace(t):
    """T6, T7."""
    x = F.col("text")
    return t("documents").select("doc_id", S.replace_first(x, "the", "<>").alias("first"), S.replace_all(x, "the", "<>").alias("every"), S.replace_matches(x, "[aeiou]{2}", "_").alias("matches"), S.replace_first_match(x, "([a-z])n", "$1-n").alias("group_first"))


@query("SELECT doc_id, len(string_split(text, '.')) AS parts, array_to_string(string_split(text, ' ')[1:3], '|') AS first_three FROM documents")
def text_split(t):
    """A limit drops the rest."""
    x = F.col("text")
    return t("documents").select("doc_id", F.size(S.split(x, ".")).cast("long").alias("parts"), F.array_join(S.split(x, " ", 3), "|").alias("first_three"))


@query("SELECT doc_id, contains(text, 'ion') AS has, starts_with(text, 'The') AS starts, ends_with(text, '.') AS ends, instr(text, 'en') - 1 AS first, CASE WHEN contains(text, 'en') THEN length(text) - instr(reverse(text), 'ne') - 1 ELSE -1 END AS last FROM documents")
def text_search(t):
    """T9, T10."""
    x = F.col("text")
    return t("documents").select("doc_id", S.includes(x, "ion").alias("has"), S.starts_with(x, "The").alias("starts"), S.ends_with(x, ".").alias("ends"), S.index_of(x, "en").alias("first"), S.last_index_of(x, "en").alias("last"))


@query("SELECT n_nationkey, substring(n_name, 2, 1) AS second, CASE WHEN length(n_name) >= 3 THEN substring(n_name, length(n_name) - 2, 1) END AS third_last, repeat('*', greatest(8 - length(n_name), 0)) || n_name AS padded, n_name || repeat('.', greatest(12 - length(n_name), 0)) AS filled, repeat(n_name, 2) AS twice FROM nation")
def text_char_pad(t):
    """T11, T12, T13."""
    x = F.col("n_name")
    return t("nation").select("n_nationkey", S.char_at(x, 1).alias("second"), S.at(x, -3).alias("third_last"), S.pad_start(x, 8, "*").alias("padded"), S.pad_end(x, 12, ".").alias("filled"), S.repeat(x, 2).alias("twice"))


@query(r"""SELECT doc_id, regexp_extract(text, 'a.(.)', 0) AS whole, regexp_extract(text, '([a-z])\.([^a-z])', 2) AS after,
regexp_replace(text, '([a-z])\.([^a-z])', '\1;\2') AS put, regexp_extract(text, '([a-z]).\n', 1) AS line_end FROM (SELECT doc_id, replace(text, 'a' || chr(10), 'b') AS text FROM documents)""")
def text_match_lines(t):
    """A dot doesn't take line ends, and all groups are of one match."""
    x = F.col("text")
    d = t("documents").select("doc_id", F.replace("text", F.lit("a\n"), F.lit("b")).alias("text"))
    first = lambda found, k: F.coalesce(F.get(found, F.lit(k)), F.lit(""))
    point = S.match(x, r"([a-z])\.([^a-z])", 2)
    return d.select("doc_id", first(S.match(x, "a.(.)", 1), 0).alias("whole"), first(point, 2).alias("after"), S.replace_first_match(x, r"([a-z])\.([^a-z])", "$1;$2").alias("put"), first(S.match(x, "([a-z]).\n", 1), 1).alias("line_end"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '([A-Z])([a-z]+)') THEN regexp_extract(text, '([A-Z])([a-z]+)', 2) END AS tail, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS n FROM documents")
def text_match(t):
    """T15, T16."""
    x = F.col("text")
    return t("documents").select("doc_id", F.get(S.match(x, "([A-Z])([a-z]+)", 2), F.lit(2)).alias("tail"), F.size(S.match_all(x, "([A-Z])([a-z]+)", 2)).cast("long").alias("n"))


@query("SELECT c_custkey, c_name || ' of ' || c_mktsegment || ' in {{z}}' AS filled FROM (SELECT c_custkey, c_name, c_mktsegment FROM customer)")
def text_template(t):
    """Placeholders in text, some of which are put in by others; unknown ones stay."""
    text = F.concat("c_name", F.lit("{{a}}"), "c_mktsegment", F.lit("{{c}}"))
    return t("customer").select("c_custkey", S.fill_template(text, {"a": " {{b}} ", "b": "of", "c": " in {{z}}"}).alias("filled"))


@query("SELECT item_id, text AS stripped FROM (SELECT item_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM benchmark)")
def text_fences(t):
    """T18."""
    return t("benchmark").select("item_id", S.strip_fences(F.concat(F.lit(" ```JS\n"), "text", F.lit("\n```\n"))).alias("stripped"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE contains(lower(c_mktsegment), 'build') GROUP BY c_mktsegment")
def text_any_case(t):
    """T20."""
    return t("customer").where(S.contains_any_case(F.col("c_mktsegment"), "  BuiLD ")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, row_number() OVER (ORDER BY n_name) AS place FROM nation")
def text_locale_order(t):
    """Locale order (of names in one case it is the binary one)."""
    placed = order.with_position(t("nation").select("n_name"), [S.locale_key(F.col("n_name"))])
    return placed.select("n_name", (F.col("_pos") + 1).alias("place"))


@query("SELECT o_orderkey, o_custkey::VARCHAR AS as_text, lower(to_base(o_orderkey, 16)) AS hex, printf('%.2f', o_totalprice) AS fixed FROM orders")
def number_text(t):
    """integers' text, another base, two decimals."""
    o = t("orders")
    return o.select("o_orderkey", V.number_string(F.col("o_custkey"), T.LongType()).alias("as_text"), V.to_radix(F.col("o_orderkey"), 16).alias("hex"), V.to_fixed(F.col("o_totalprice"), 2).alias("fixed"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_quantity AS BIGINT)::VARCHAR AS quantity_text, CASE WHEN l_discount = 0 THEN '0' ELSE l_discount::VARCHAR END AS discount_text FROM lineitem")
def number_double_text(t):
    """doubles' text, whole ones without a fraction."""
    rows = t("lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", V.number_string(F.col("l_quantity"), T.DoubleType()).alias("quantity_text"), V.number_string(F.col("l_discount"), T.DoubleType()).alias("discount_text"))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS x, CASE WHEN o_totalprice >= 100000 THEN 5 ELSE 4 END AS e FROM orders WHERE o_totalprice >= 10000 AND o_totalprice < 990000),
n AS (SELECT o_orderkey, e, (x * 100 + 50 * (10 ** (e - 2))::BIGINT)::BIGINT // (100 * (10 ** (e - 2))::BIGINT) AS a, (x * 100 + 50 * (10 ** (e - 3))::BIGINT)::BIGINT // (100 * (10 ** (e - 3))::BIGINT) AS b FROM o)
SELECT o_orderkey, CASE WHEN a >= 1000 THEN '1.00e+' || (e + 1) ELSE (a // 100) || '.' || lpad((a % 100)::VARCHAR, 2, '0') || 'e+' || e END AS exponential,
CASE WHEN b >= 10000 THEN '1.000e+' || (e + 1) ELSE (b // 1000) || '.' || lpad((b % 1000)::VARCHAR, 3, '0') || 'e+' || e END AS precise FROM n""")
def number_exponential(t):
    """With an exponent, and with four significant digits."""
    rows = t("orders").where("o_totalprice >= 10000 and o_totalprice < 990000")
    return rows.select("o_orderkey", V.to_exponential(F.col("o_totalprice"), 2).alias("exponential"), V.to_precision(F.col("o_totalprice"), 4).alias("precise"))


@query(r"SELECT event_id, coalesce(try_cast(regexp_extract(event_type || event_id::VARCHAR, '[0-9]+') AS DOUBLE), 0) AS a, 0::DOUBLE AS b, coalesce(value, 0) AS c FROM events")
def number_coerced(t):
    """What reads as a number, else 0."""
    e = t("events")
    digits = F.concat(F.lit(" "), F.regexp_extract(F.concat("event_type", F.col("event_id").cast("string")), "[0-9]+", 0), F.lit("\n"))
    return e.select("event_id", V.to_number(digits, T.StringType()).alias("a"), V.to_number(F.col("event_type"), T.StringType()).alias("b"), V.to_number(F.col("value"), T.DoubleType()).alias("c"))


@query("SELECT l_returnflag, (l_quantity > 25)::VARCHAR AS big, count(*) AS n FROM lineitem GROUP BY ALL")
def boolean_text(t):
    """N7, N8."""
    big = V.string_of(F.col("l_quantity") > 25, T.BooleanType())
    return t("lineitem").groupBy("l_returnflag", big.alias("big")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT array_to_string(json_keys(props), ',') AS keys, count(*) AS n, count(*) FILTER (json_exists(props, '$.k')) AS with_k, count(*) FILTER (json_exists(props, '$.zz')) AS with_zz FROM events GROUP BY ALL")
def object_keys(t):
    """O1, O3: keys of JSON objects, and whether they have one."""
    v = F.parse_json("props")
    return t("events").groupBy(F.array_join(V.json_keys(F.col("props")), ",").alias("keys")).agg(F.count(F.lit(1)).alias("n"), F.count_if(V.has_key(v, "k")).alias("with_k"), F.count_if(V.has_key(v, "zz")).alias("with_zz"))


@query("SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events")
def object_entries(t):
    """O2: a row for each entry."""
    parsed = t("events").select("event_id", F.from_json("props", "map<string,long>").alias("m"))
    return parsed.select("event_id", F.explode("m").alias("key", "value"))


@query("SELECT event_id, 'object' AS whole, 'number' AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def object_types(t):
    """O4."""
    v = F.parse_json("props")
    kind = lambda path: V.json_type(F.variant_get(v, path, "variant"))
    return t("events").select("event_id", kind("$").alias("whole"), kind("$.k").alias("k"), kind("$.zz").alias("missing"))


@query("SELECT c_custkey, to_json({'k': c_custkey, 'n': c_name, 'l': [c_nationkey, 1]})::VARCHAR AS compact FROM customer")
def object_json(t):
    """O5."""
    row = F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"), F.array("c_nationkey", F.lit(1)).alias("l"))
    df = t("customer").select("c_custkey", row.alias("o"))
    return df.select("c_custkey", V.to_json_text(F.col("o"), df.schema["o"].dataType).alias("compact"))


@query("SELECT l_orderkey, l_linenumber, '{\"price\":' || CASE WHEN l_extendedprice = floor(l_extendedprice) THEN CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR) ELSE CAST(l_extendedprice AS VARCHAR) END || ',\"text\":\"x,1.0,y\",\"large\":' || CAST(CAST(l_quantity AS BIGINT) * 10000000 AS VARCHAR) || ',\"list\":[' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ',null,0.00001]}' AS compact FROM lineitem")
def object_json_numbers(t):
    """numbers' text inside JSON, and strings that look like numbers."""
    row = F.struct(F.col("l_extendedprice").alias("price"), F.lit("x,1.0,y").alias("text"), (F.col("l_quantity") * 1e7).alias("large"), F.array("l_quantity", F.lit(None).cast("double"), F.lit(0.00001)).alias("list"))
    df = t("lineitem").select("l_orderkey", "l_linenumber", row.alias("o"))
    return df.select("l_orderkey", "l_linenumber", V.to_json_text(F.col("o"), df.schema["o"].dataType).alias("compact"))


@query("SELECT l_orderkey, array_to_string(list(CAST(CAST(l_quantity AS BIGINT) * 10000000 AS VARCHAR) ORDER BY l_quantity), ',') AS large FROM lineitem GROUP BY l_orderkey")
def array_number_text(t):
    """The text of arrays of doubles."""
    grouped = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_quantity") * 1e7)).alias("a"))
    return grouped.select("l_orderkey", V.string_of(F.col("a"), grouped.schema["a"].dataType).alias("large"))


@query("SELECT c_custkey, '[object Object]' AS whole FROM customer")
def object_text(t):
    """An object's text."""
    df = t("customer").select("c_custkey", F.struct("c_name", "c_acctbal").alias("o"))
    return df.select("c_custkey", V.string_of(F.col("o"), df.schema["o"].dataType).alias("whole"))


@query("SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS hex, CAST(o_custkey AS DOUBLE) AS octal, CAST(o_orderkey AS DOUBLE) AS binary FROM orders")
def number_coerced_bases(t):
    """0x, 0o and 0b."""
    in_base = lambda c, base, sign: V.to_number(F.concat(F.lit(" 0" + sign), F.conv(F.col(c).cast("string"), 10, base)), T.StringType())
    return t("orders").select("o_orderkey", in_base("o_orderkey", 16, "x").alias("hex"), in_base("o_custkey", 8, "o").alias("octal"), in_base("o_orderkey", 2, "B").alias("binary"))


@query("SELECT n_nationkey, '{' || chr(10) || '  \"k\": ' || n_nationkey || ',' || chr(10) || '  \"n\": \"' || n_name || '\"' || chr(10) || '}' AS pretty FROM nation")
def object_pretty_json(t):
    """O6."""
    return t("nation").select("n_nationkey", V.pretty_json(F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n")))).alias("pretty"))
