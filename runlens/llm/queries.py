"""The named queries of this package; each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.text import let
from runlens.llm import (
    alignment,
    exact_dedup,
    language,
    mixing,
    near_dedup,
    packing,
    periodic,
    quality,
    secrets,
    sharding,
    token_counts,
    url_filter,
    vector_dedup,
)

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = sql
        return build

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(
    "op9_exact_dedup",
    r"""
    with texts as (
        select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
        from documents
    ),
    sizes as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from texts group by text_sha256)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256
    from texts join sizes using (text_sha256)
    """,
)
def op9_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@query(
    "op1_poisson_mixing",
    """
    with texts as (
        select doc_id, source, coalesce('s' || source, 'null') as k, strlen(coalesce(text, '')) as n,
               coalesce(doc_id::varchar, md5(coalesce(text, ''))) as name
        from documents
    ),
    sources as (select k, sum(n)::double as b from texts group by k),
    rates as (
        select k, case when b > 0 then pow(b, 0.5) / sum(case when b > 0 then pow(b, 0.5) end) over ()
                                       * sum(b) over () / b else 1.0 end as rate
        from sources
    ),
    terms as (
        select k, i, rate,
               case when i = 0 then -rate else ln(rate) - ln(greatest(i, 1)::double) end as step
        from rates, generate_series(0, 400) as g(i) where i <= ceil(rate + 12 * sqrt(rate) + 30)
    ),
    logs as (select k, i, exp(sum(step) over (partition by k order by i)) as p from terms),
    steps as (select k, floor(sum(p) over (partition by k order by i) * 4503599627370496.0)::bigint as s from logs),
    drawn as (
        select doc_id, source, name,
               (select count(*) from steps where steps.k = texts.k
                and s <= ('0x' || substr(md5('42:' || name), 1, 13))::bigint) as copies
        from texts
    ),
    copied as (
        select doc_id, source, name, unnest(generate_series(1, copies))::int as copy from drawn where copies > 0
    ),
    ordered as (
        select *, ('0x' || substr(md5('42:order:' || name || ':' || copy), 1, 13))::bigint as o from copied
    )
    select doc_id, source, copy, row_number() over (order by o, doc_id, copy) - 1 as position from ordered
    """,
)
def op1_poisson_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.positions(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@query("op3_minimum_bin_slack")
def op3_minimum_bin_slack(spark: SparkSession, sf: str) -> DataFrame:
    names = {"id": "doc_id", "crc": "ids_crc32", "tokens": "doc_tokens", "sequence": "sequence_id"}
    return packing.pack(table(spark, sf, "documents")).withColumnsRenamed(names)


@query("op2_zstd_novelty")
def op2_zstd_novelty(spark: SparkSession, sf: str) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def line(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return secrets.scan(table(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"),
        *[count(k) for k in ("assign", "access", "hex")],
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )


@query("op6_kd_tree")
def op6_kd_tree(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(table(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    "op5_signature_join",
    r"""
    with recursive words as (
        select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
        from documents
    ),
    shingles as (
        select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s
        from words
    ),
    sizes as (select doc_id, count(*) as n from shingles group by doc_id),
    shared as (
        select a.doc_id as a, b.doc_id as b, count(*) as n
        from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all
    ),
    edges as (
        select shared.a, shared.b from shared join sizes x on x.doc_id = shared.a join sizes y on y.doc_id = shared.b
        where 100 * shared.n >= 80 * (x.n + y.n - shared.n)
    ),
    reach as (
        select doc_id as node, doc_id as top from documents
        union
        select edges.b, reach.top from reach join edges on edges.a = reach.node
    )
    select d.doc_id, coalesce(sizes.n, 0) as n_shingles, r.top as component_id, d.doc_id = r.top as kept
    from documents d left join sizes using (doc_id) join (select node, min(top) as top from reach group by node) r on r.node = d.doc_id
    """,
)
def op5_signature_join(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf, "documents"), words=4).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept"
    )


@query(
    "op7_inverted_multi_index",
    """
    with recursive vectors as (
        select vec_id, embedding::double[] as e, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as n
        from embeddings
    ),
    good as (select * from vectors where n > 0 and isfinite(n) and len(list_filter(e, lambda x: x is null)) = 0),
    edges as (
        select a.vec_id as a, b.vec_id as b
        from good a join good b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
        where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
    ),
    reach as (
        select vec_id as node, vec_id as top from embeddings
        union
        select edges.b, reach.top from reach join edges on edges.a = reach.node
    ),
    tops as (select node, min(top) as component_id from reach group by node),
    counts as (select a, count(*) as n from edges group by a)
    select node as vec_id, coalesce(n, 0) as n_links, component_id, node = component_id as kept
    from tops left join counts on a = node
    """,
)
def op7_inverted_multi_index(spark: SparkSession, sf: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf, "embeddings")).withColumnRenamed("id", "vec_id")


#: The rules of the query's contract.
RULES = [
    url_filter.Rule("allow", "com/"),
    url_filter.Rule("block", "example.com/en/"),
    url_filter.Rule("allow", "www.example.com/en/"),
    url_filter.Rule("block", "net/es/"),
    url_filter.Rule("block", "net/fr/"),
]


def _link_graph_sql() -> str:
    def longest(value: str) -> str:
        cases = sorted(reversed(RULES), key=lambda r: -len(r.text))
        lines = [
            f"when (host = '{r.host}' or host like '%.{r.host}') and starts_with(path, '{r.path}') then '{getattr(r, value)}'"
            for r in cases
        ]
        return f"case {' '.join(lines)} end"

    share = 100 - url_filter.FLOW
    rounds = "".join(
        f"""
        m{i + 1} as materialized (
            select host, kind, sum(mass)::bigint as mass from (
                select w.t as host, w.kind, mass * {url_filter.FLOW} // 100 // degree as mass
                from m{i} m join ways w on w.f = m.host and w.kind = m.kind
                union all select host, kind, seed * {share} // 100 from start
            ) group by all
        ),"""
        for i in range(url_filter.ROUNDS)
    )
    return rf"""
    with rows as (
        select page_id, html,
               translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
               regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
        from pages
    ),
    judged as (select *, {longest('text')} as rule, {longest('verdict')} as ruled from rows),
    refs as (select host as f, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1)) as link from rows),
    links as (
        select distinct f, t from (
            select f, translate(regexp_extract(case when starts_with(link, '//') then 'x:' || link else link end,
                                               '(?s)^.*?://([^/?#]*)', 1),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
            from refs where starts_with(link, '//') or contains(link, '://')
        ) where f <> t and f <> '' and t <> ''
    ),
    both_ways as (select f, t, 'trust' as kind from links union all select t, f, 'distrust' from links),
    ways as (select *, count(*) over (partition by f, kind) as degree from both_ways),
    seeds as (
        select host, case when count(*) filter (ruled = 'allow') * 2 > count(*) then 'trust'
                          when count(*) filter (ruled = 'block') * 2 > count(*) then 'distrust' end as kind
        from judged where host <> '' group by host
    ),
    start as (select host, kind, {url_filter.MASS} // count(*) over (partition by kind) as seed from seeds where kind is not null),
    m0 as (select host, kind, seed as mass from start),{rounds}
    bad as (
        select host from m{url_filter.ROUNDS} group by host
        having coalesce(sum(mass) filter (kind = 'distrust'), 0) > coalesce(sum(mass) filter (kind = 'trust'), 0)
    )
    select page_id, host, path, rule, coalesce(ruled, case when bad.host is not null then 'block' else 'allow' end) as verdict
    from judged left join bad using (host)
    """


@query("op4_link_graph", _link_graph_sql())
def op4_link_graph(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages"), RULES).withColumnRenamed("id", "page_id")


@query("op8_ordinal_quality")
def op8_ordinal_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.train(docs, quality.graded(table(spark, sf, "labels")), quality.GOOD)
    return quality.rate(docs, model, quality.GOOD).select(
        F.col("id").alias("doc_id"), "score", "expected_grade", F.col("tail").alias("tail_probability"), "kept"
    )


#: Levels of the SQL below: periods up to 2**15, so texts of up to 131,072 words.
SQL_LEVELS = 16


def _periodic_sql() -> str:
    levels = "".join(
        f"""
        g{j} as (
            select doc_id, n, i, md5(g || ' ' || lead(g, {1 << (j - 1)}) over (partition by doc_id order by i)) as g
            from g{j - 1} where n >= {4 * ((1 << (j - 1)) + 1)}
        ),"""
        for j in range(1, SQL_LEVELS)
    )
    gaps = " union all ".join(
        f"select doc_id, i, {1 << j} as width, i - lag(i) over (partition by doc_id, g order by i) as q from g{j} where g is not null"
        for j in range(SQL_LEVELS)
    )
    return rf"""
    with bits as (
        select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)
                    order by i) as t
        from range(256) r(i)
    ),
    numbers as (
        select doc_id, xor(list_reduce(list_transform(regexp_split_to_array(doc_id::varchar, ''), lambda x: ord(x)::bigint),
            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295) as h
        from documents, bits
    ),
    texts as (
        select doc_id, h, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') as w
        from documents join numbers using (doc_id)
    ),
    planted as (
        select doc_id, len(w)::bigint as n, w, h % 10 = 0 and len(w) > 0 as made, (h // 10) % greatest(len(w), 1) as a,
               1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) as p
        from texts
    ),
    words as (
        select doc_id, n, i, case when made and i >= a then w[a + (i - a) % p + 1] else w[i + 1] end as g
        from (select *, unnest(range(n)) as i from planted)
    ),
    g0 as materialized (select * from words),{levels}
    gaps as ({gaps}),
    islands as (
        select *, i - row_number() over (partition by doc_id, width, q order by i) as island
        from gaps where q * 2 > width and q <= width
    ),
    runs as (
        select doc_id, min(i) - q as start, max(i) + width - min(i) + q as length, q as period
        from islands group by doc_id, width, q, island
        having max(i) + width - min(i) + q >= greatest(6, 4 * q)
    ),
    turns as (
        select doc_id, i, sum(turn) as turn from (
            select doc_id, start + period as i, 1 as turn from runs union all select doc_id, start + length, -1 from runs
        ) group by doc_id, i
    ),
    kept as (
        select doc_id, string_agg(g, ' ' order by i) as text from (
            select doc_id, i, g, sum(coalesce(turn, 0)) over (partition by doc_id order by i) as inside
            from words left join turns using (doc_id, i)
        ) where inside = 0 group by doc_id
    ),
    listed as (
        select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs,
               min({{'length': -length, 'start': start, 'period': period}}) as best
        from runs group by doc_id
    )
    select doc_id, coalesce(n_runs, 0) as n_runs, best.start as start, -best.length as length, best.period as period,
           1000 * -best.length // best.period as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256,
           sha256(coalesce(kept.text, '')) as collapsed_sha256
    from documents left join listed using (doc_id) left join kept using (doc_id)
    """


def repeated_tail(doc_id: str, text: str) -> Column:
    """The text whose words repeat from some place on, in every tenth document by the checksum of its id (as the contract says)."""
    checksum = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(checksum / 10).cast("long")
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def made(w: Column) -> Column:
        n = F.size(w).cast("long")

        def turned(bounds: Column) -> Column:
            a, p = bounds["a"], bounds["p"]
            places = F.sequence(F.lit(0).cast("long"), n - 1)
            return F.array_join(
                F.transform(places, lambda i: F.get(w, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))), " "
            )

        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), turned)).otherwise(F.lit(""))

    return F.when(checksum % 10 == 0, let(words, made)).otherwise(F.col(text))


@query("op12_periodic_runs", _periodic_sql())
def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", repeated_tail("doc_id", "text").alias("text"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"], r["period"])))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return (
        periodic.collapse(docs)
        .withColumn("_best", best)
        .select(
            F.col("id").alias("doc_id"),
            F.size("runs").cast("long").alias("n_runs"),
            F.col("_best.start").alias("start"),
            (-F.col("_best.length")).alias("length"),
            F.col("_best.period").alias("period"),
            F.floor(-1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
            F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


@query("op13_cross_tokenizer_alignment")
def op13_cross_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    def digest(groups: Column) -> Column:
        return F.when(F.length(groups) > 0, F.sha2(groups, 256)).otherwise(F.lit(""))

    return alignment.align(table(spark, sf, "documents"), shown=digest).select(
        F.col("id").alias("doc_id"),
        "n_a",
        "n_b",
        F.col("n_links").alias("n_groups"),
        "n_links",
        "n_best",
        "count_sum",
        F.col("groups").alias("groups_sha256"),
    )


@query("op11_script_viterbi")
def op11_script_viterbi(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.train(docs, where=F.col("doc_id").isNotNull() & ~held_out)
    labelled = language.label(docs, model).withColumnRenamed("id", "doc_id")
    return labelled.select(
        "doc_id", held_out.alias("held_out"), F.col("lang").alias("lang_pred"), "score", F.size("spans").cast("long").alias("n_spans")
    )
