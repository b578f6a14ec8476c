"""Registered queries of the corpus operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridseries.catalog.registry import registry
from gridseries.llm import (
    exact_dedup,
    index_match,
    language_id,
    line_dedup,
    ngram_join,
    packing,
    personal_data,
    pivot_clustering,
    prefix_trie,
    repeated_bytes,
    secret_scan,
    token_counts,
    token_files,
)
from gridseries.llm.batches import ship_code
from gridseries.session import new_folder

QUERIES, register = registry()


def table(spark, sf, name):
    ship_code(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


@register(
    "op8_exact_dedup",
    """
    with t as (
      select doc_id, length(coalesce(text, '')) as points,
             regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as norm
      from documents)
    select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
           row_number() over w = 1 as kept, sha256(norm) as text_sha256
    from t window w as (partition by norm order by points desc, doc_id)
    """,
)
def op8_exact_dedup(spark, sf):
    return exact_dedup.exact_dedup(table(spark, sf, "documents"))


@register(
    "op10_line_dedup",
    """
    with shown as (
      select page_id,
        lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host,
        regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
          '(?is)<(script|style)[^>]*>.*?</(script|style)>', chr(10), 'g'), '<[^>]*>', chr(10), 'g'),
          '[\\x09\\x0B-\\x0D\\x20]+', ' ', 'g') as text
      from pages),
    split as (
      select page_id, host,
        list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as lines
      from shown),
    sites as (select host, count(*) as n_pages from split group by host),
    counts as (
      select host, line, count(*) as n
      from (select host, unnest(list_distinct(lines)) as line from split) group by host, line),
    boiler as (
      select host, list(line) as boiler from counts join sites using (host)
      where n_pages >= 5 and n > 0.3 * n_pages group by host),
    kept as (
      select page_id, host, lines,
        list_filter(lines, lambda x: not list_contains(coalesce(boiler, []::varchar[]), x)) as kept
      from split left join boiler using (host))
    select page_id, host, len(lines)::bigint as n_lines, (len(lines) - len(kept))::bigint as n_dropped,
      sha256(coalesce(array_to_string(kept, chr(10)), '')) as kept_sha256
    from kept
    """,
)
def op10_line_dedup(spark, sf):
    out = line_dedup.drop_site_lines(table(spark, sf, "pages"))
    return out.select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@register("op9_token_files")
def op9_token_files(spark, sf):
    folder = new_folder(spark, "token_files")
    token_files.write_token_files(table(spark, sf, "documents"), folder)
    return token_files.read_token_files(spark, folder)


@register("op3_best_fit_packing")
def op3_best_fit_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


@register(
    "op4_benchmark_index",
    """
    with w as (
      select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as words
      from documents),
    iw as (
      select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as words
      from benchmark),
    item_windows as (
      select item_id, least(len(words), 10) as k, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') as win
      from (select item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as i from iw where len(words) > 0)),
    doc_windows as (
      select doc_id, i, k, array_to_string(words[i : i + k - 1], ' ') as win
      from (select doc_id, words, k, unnest(range(1, len(words) - k + 2)) as i
            from w, (select distinct k from item_windows) where len(words) >= k)),
    matches as (
      select distinct doc_id, i, d.k, item_id from doc_windows d join item_windows using (k, win)),
    hits as (
      select doc_id, count(distinct p) as n_hit
      from (select doc_id, unnest(range(i, i + k)) as p from matches) group by doc_id),
    found as (
      select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
      from (select distinct doc_id, item_id::varchar as item from matches) group by doc_id)
    select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
      coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
      coalesce(n_hit, 0) > 0 as contaminated
    from w left join hits using (doc_id) left join found using (doc_id)
    """,
)
def op4_benchmark_index(spark, sf):
    out = index_match.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@register("op2_token_counts")
def op2_token_counts(spark, sf):
    return token_counts.count_tokens(table(spark, sf, "documents"))


def span_list(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@register("op7_secret_scan")
def op7_secret_scan(spark, sf):
    found = secret_scan.find_secrets(table(spark, sf, "documents"))

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        *[number(kind) for kind in secret_scan.KINDS],
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


@register("op5_language_id")
def op5_language_id(spark, sf):
    return language_id.identify(table(spark, sf, "documents"))


@register(
    "op1_ngram_join",
    """
    with recursive words as materialized (
      select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
      from documents),
    sets as materialized (
      select distinct r, doc_id, array_to_string(w[i : i + 2], ' ') as shingle
      from (select r, doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from words where len(w) > 0)),
    sizes as (select r, count(*) as n from sets group by r),
    met as (
      select a.r as a, b.r as b, count(*) as shared
      from sets a join sets b on a.shingle = b.shingle and a.r <> b.r
      where a.doc_id is not null and b.doc_id is not null group by 1, 2),
    links as (
      select a, b from met join sizes x on x.r = a join sizes y on y.r = b
      where 100 * shared >= 90 * (x.n + y.n - shared)),
    reach(r, seen) as (
      select r, r from words where doc_id is not null union select r.r, l.b from reach r join links l on l.a = r.seen),
    least as (select reach.r, min(doc_id) as component_id from reach join words on words.r = seen group by reach.r)
    select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
    from words left join sizes using (r) left join least using (r)
    """,
)
def op1_ngram_join(spark, sf):
    return ngram_join.linked_groups(table(spark, sf, "documents"))


@register("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf):
    return repeated_bytes.remove_repeats(table(spark, sf, "documents"))


def clustering_sql(rounds: int = 3, centroids: int = 16) -> str:
    """Plain k-means over all pairs of vector and centroid, one set of tables per round."""
    floor_mean = "cast((s - ((s % n) + n) % n) // n as bigint)"
    parts = [
        """
        kept as (
          select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v
          from embeddings
          where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
        c0 as (
          select row_number() over (order by h nulls last, v) - 1 as c, v
          from (select sha256('1:' || vec_id::varchar) as h, v from kept)
          qualify c < %d)"""
        % centroids
    ]
    near = """
        a{k} as (
          select r, vec_id, kept.v as v, min(struct_pack(
            d := list_sum(list_transform(range(1, 65), lambda i: (kept.v[i] - m.v[i]) * (kept.v[i] - m.v[i])))::bigint,
            c := m.c)) as best
          from kept cross join c{k} m group by r, vec_id, kept.v)"""
    for k in range(rounds):
        parts.append(near.format(k=k))
        parts.append(
            f"""
        c{k + 1} as (
          select c{k}.c as c, coalesce(moved.v, c{k}.v) as v
          from c{k} left join (
            select c, list({floor_mean} order by i) as v
            from (select best.c as c, i, sum(v[i]) as s, count(*) as n
                  from a{k} cross join (select unnest(range(1, 65)) as i) group by best.c, i) group by c) moved
          using (c))"""
        )
    parts.append(near.format(k=rounds))
    return (
        "with "
        + ",".join(parts)
        + f"""
        select vec_id, best.c::integer as cluster, best.d as distance,
          sum(best.d) over (partition by best.c)::bigint as cluster_inertia, sum(best.d) over ()::bigint as inertia,
          sha256(array_to_string(m.v, ',')) as centroid_sha256
        from a{rounds} join c{rounds} m on m.c = best.c"""
    )


@register("op11_centroid_clustering", clustering_sql())
def op11_centroid_clustering(spark, sf):
    return pivot_clustering.cluster(table(spark, sf, "embeddings"))


@register("op12_personal_data")
def op12_personal_data(spark, sf):
    found = personal_data.find_personal_data(table(spark, sf, "documents"))

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*personal_data.KINDS))
    return found.select(
        "doc_id",
        *[number(kind) for kind in personal_data.KINDS],
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


@register(
    "op13_prefix_trie",
    """
    with turns as (
      select conv_id as c, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) as t,
        row_number() over (partition by conv_id order by turn nulls first) - 1 as pos
      from conversations where conv_id is not null),
    convs as (
      select c, c - c % 100 as base,
        xor(4294967295, list_reduce(
          list_concat([4294967295], list_transform(range(1, length(c::varchar) + 1), lambda i: ascii((c::varchar)[i])::bigint)),
          lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 6 as h
      from (select distinct c from turns)),
    rebuilt as (
      select convs.c, t, row_number() over (partition by convs.c order by own, pos) as d
      from convs join (
        select c as k, t, pos, 0 as own from turns union all select c, t, pos, 1 from turns) p
      on (own = 0 and p.k = base and pos < h) or (own = 1 and p.k = convs.c and pos >= h)),
    seqs as (
      select convs.c, coalesce(s, []) as s
      from convs left join (select c, list(t order by d) as s from rebuilt group by c) using (c)),
    paths as (
      select c, d, len(s) as l, sha256(to_json(s[1 : d])::varchar) as node, length(s[d].text) as chars,
        case when d > 0 then sha256(to_json(s[1 : d - 1])::varchar) end as parent
      from (select c, s, unnest(range(0, len(s) + 1)) as d from seqs)),
    nodes as (
      select node, d, any_value(parent) as parent, min(c) as conv_id, count(*) as n_convs,
        coalesce(any_value(chars), 0) as chars, string_agg(c::varchar, ',' order by c) filter (l = d) as ends
      from paths group by node, d),
    kids as (select parent as node, count(*) as n_children from nodes group by parent),
    below as (
      select distinct a.node as node, b.node as under
      from paths a join paths b on a.c = b.c and b.d >= a.d),
    sums as (
      select below.node, sum(coalesce(n_children, 0) = 0)::bigint as n_leaves,
        sum((n_convs - 1) * chars)::bigint as saved_tokens
      from below join nodes on nodes.node = under left join kids on kids.node = under group by below.node)
    select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children,
      n_leaves, saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
    from nodes n join sums using (node) left join kids using (node) left join nodes p on p.node = n.parent
    """,
)
def op13_prefix_trie(spark, sf):
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"))
