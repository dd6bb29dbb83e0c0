"""The same results as ``kindred.queries`` in plain SQL, for checking."""

from __future__ import annotations

from kindred.functions.text import STOP_WORDS
from kindred.operators.histogram import LOG_BOUNDS
from kindred.params import Params, to_nano
from kindred.queries import (
    CLAMPED,
    CLOSE,
    CUSTOM,
    CUT,
    LINEAR,
    NOW_MS,
    ONE_BLOCK,
    PHRASES,
    PRIOR,
    SMALL_BLOCKS,
    WHOLE,
    WITHOUT_BLOCKS,
)

KEYS = "namespace, collection_key"
DOCS = "SELECT 'demo' AS namespace, lang AS collection_key, doc_id, text FROM documents"


def with_ctes(ctes: dict[str, str], query: str, recursive: bool = False) -> str:
    parts = [
        f"{name} AS ({sql})" if name.startswith("walk") else f"{name} AS MATERIALIZED ({sql})"
        for name, sql in ctes.items()
    ]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + query


# Import

PLAIN_OPINIONS = """
SELECT CAST(doc_id AS VARCHAR) AS id, 'document' AS type, source AS product, lang AS locale, text
FROM documents"""

OPINIONS = """
SELECT CAST(d.doc_id AS VARCHAR) AS id, 'document' AS type, d.source AS product,
       d.lang AS locale, CASE WHEN l.toxic = 1 THEN '' ELSE d.text END AS text
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
UNION ALL
SELECT conv_id || ':' || turn, role, 'chat', 'any', text FROM conversations"""

FAN_OUT = f"""
SELECT 'demo' AS namespace, unnest([locale, product || ':' || locale, type || '-' || locale])
       AS collection_key, id AS doc_id, text
FROM ({OPINIONS}) WHERE length(text) > 0"""

SIZES = f"SELECT {KEYS}, count(*) AS size, {NOW_MS} AS modified_ms FROM ({FAN_OUT}) GROUP BY ALL"



def two_namespaces(talks_size: int) -> str:
    return f"""
SELECT 'texts' AS namespace, lang AS collection_key, CAST(doc_id AS VARCHAR) AS doc_id, text,
       count(*) OVER (PARTITION BY lang) AS size, {NOW_MS} AS modified_ms
FROM documents WHERE length(text) > 0
UNION ALL
SELECT 'talks', role, conv_id || ':' || turn, text, {talks_size} * count(*) OVER (PARTITION BY role), {NOW_MS}
FROM conversations WHERE length(text) > 0"""


LOADS = """
SELECT event_id AS load_seq, 'demo' AS namespace, CAST(user_id AS VARCHAR) AS collection_key,
       CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) END AS size,
       CASE WHEN event_type = 'click' THEN event_id END AS modified_ms,
       CASE WHEN event_type = 'purchase' THEN event_id END AS rebuilt_ms,
       CASE WHEN event_type = 'signup' THEN event_id END AS processed_ms
FROM events"""


def last(column: str) -> str:
    return f"arg_max({column}, load_seq) FILTER ({column} IS NOT NULL) AS {column}"


STATE = f"""
SELECT {KEYS}, {last('size')}, {last('modified_ms')}, {last('rebuilt_ms')}, {last('processed_ms')}
FROM ({LOADS}) GROUP BY ALL"""

FIELDS = (
    "id timestamp type product version platform locale manufacturer device url text".split()
)


# Vectorise


def vector_ctes(params: Params = ONE_BLOCK) -> dict[str, str]:
    stop_words = ", ".join(f"'{w}'" for w in STOP_WORDS)
    drop = params.min_df_mode == "drop"
    return {
        "docs": DOCS,
        "terms": rf"""
SELECT {KEYS}, doc_id, [t FOR t IN regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')
       IF t NOT IN ({stop_words})] AS found FROM docs""",
        "tok": f"""
SELECT {KEYS}, doc_id, unnest(found) AS term, generate_subscripts(found, 1) - 1 AS place
FROM terms""",
        "tf": f"SELECT {KEYS}, doc_id, term, count(*) AS tf FROM tok GROUP BY ALL",
        "sizes": f"SELECT {KEYS}, count(DISTINCT doc_id) AS n_docs FROM tf GROUP BY ALL",
        "dict": f"""
SELECT {KEYS}, term, CAST(sum(tf) AS BIGINT) AS cf,
       {"count(*)" if drop else f"greatest(count(*), {params.min_df})"} AS df, max(n_docs) AS n_docs
FROM tf JOIN sizes USING ({KEYS}) GROUP BY {KEYS}, term
HAVING sum(tf) >= {params.min_support} AND count(*) >= {params.min_df if drop else 0}
   AND 100.0 * count(*) / max(n_docs) <= {params.max_df_percent}""",
        "weighted": f"""
SELECT {KEYS}, doc_id, term, greatest(sqrt(tf) * (1 + ln(n_docs / (df + 1))), 0) AS weight
FROM tf JOIN dict USING ({KEYS}, term)""",
        "norms": f"SELECT {KEYS}, doc_id, sqrt(sum(weight * weight)) AS norm "
        "FROM weighted GROUP BY ALL",
        "vec": f"""
SELECT {KEYS}, doc_id, term, log2(1 + weight) / norm AS w
FROM weighted JOIN norms USING ({KEYS}, doc_id)""",
    }


def entropy_sql(*counts: str) -> str:
    each = " - ".join(f"CASE WHEN {n} > 0 THEN CAST({n} AS DOUBLE) * ln(CAST({n} AS DOUBLE)) ELSE 0 END" for n in counts)
    total = f"({' + '.join(counts)})"
    return f"(CASE WHEN {total} > 0 THEN CAST({total} AS DOUBLE) * ln(CAST({total} AS DOUBLE)) ELSE 0 END - {each})"


def ratio_sql(both: str, first: str, second: str, neither: str) -> str:
    rows = entropy_sql(f"({both} + {first})", f"({second} + {neither})")
    columns = entropy_sql(f"({both} + {second})", f"({first} + {neither})")
    return f"greatest(2.0 * ({rows} + {columns} - {entropy_sql(both, first, second, neither)}), 0.0)"


def gram_ctes(params: Params = PHRASES) -> dict[str, str]:
    """CTEs of term counts, with n-grams among them."""
    ctes = vector_ctes(params)
    head = {n: ctes[n] for n in ("docs", "terms", "tok")}
    runs = " UNION ALL ".join(
        f"SELECT {KEYS}, doc_id, CAST({n} AS INT) AS n, array_to_string(found[i : i + {n - 2}], ' ') AS head, found[i + {n - 1}] AS tail "
        f"FROM (SELECT *, unnest(range(1, len(found) - {n - 2})) AS i FROM terms)"
        for n in range(2, params.max_ngram + 1)
    )
    of = f"PARTITION BY {KEYS}, n"
    head["runs"] = runs
    head["counted"] = f"""
SELECT {KEYS}, n, head, tail, count(*) AS c FROM runs GROUP BY ALL"""
    head["margins"] = f"""
SELECT *, CAST(sum(c) OVER ({of}, head) AS BIGINT) AS h, CAST(sum(c) OVER ({of}, tail) AS BIGINT) AS t,
       CAST(sum(c) OVER ({of}) AS BIGINT) AS every FROM counted"""
    head["judged"] = f"""
SELECT {KEYS}, n, head, tail, c, {ratio_sql('c', '(h - c)', '(t - c)', '(every - h - t + c)')} AS llr
FROM margins WHERE c >= {params.min_support}"""
    head["kept"] = f"SELECT * FROM judged WHERE llr >= {params.min_llr}"
    head["tf"] = f"""
{ctes['tf']} UNION ALL
SELECT {KEYS}, doc_id, head || ' ' || tail AS term, count(*) AS tf FROM runs JOIN kept USING ({KEYS}, n, head, tail)
GROUP BY ALL"""
    return {**head, **{n: ctes[n] for n in ("sizes", "dict")}}


# Cluster


def pass_ctes(p: str, vec: str, params: Params, order: str = "doc_id") -> dict[str, str]:
    """One clustering pass over the vectors ``vec``; all names begin with ``p``."""
    size = params.block_size
    block = f"{KEYS}, block_id"
    places = (
        "CAST(0 AS BIGINT) AS block_id, CAST(idx AS INT) AS pos,\n       CAST(n AS INT)"
        if size is None
        else f"""idx // {size} AS block_id, CAST(idx % {size} AS INT) AS pos,
       CAST(least({size}, n - idx // {size} * {size}) AS INT)"""
    )
    return {
        f"{p}elig": f"""
SELECT {KEYS}, doc_id, {order} AS place, count(*) AS n_terms FROM {vec}
GROUP BY ALL HAVING count(*) >= {params.min_terms}""",
        f"{p}num": f"""
SELECT {KEYS}, doc_id, row_number() OVER (PARTITION BY {KEYS} ORDER BY place) - 1 AS idx,
       count(*) OVER (PARTITION BY {KEYS}) AS n FROM {p}elig""",
        f"{p}blk": f"""
SELECT {KEYS}, doc_id, {places} AS block_docs FROM {p}num""",
        f"{p}post": f"""
SELECT {block}, pos, term, w FROM {vec} JOIN {p}blk USING ({KEYS}, doc_id)""",
        f"{p}pairs": f"""
SELECT a.namespace, a.collection_key, a.block_id, a.pos AS a, b.pos AS b,
       CAST(round(sum(a.w * b.w) * 1e9) AS BIGINT) AS sim_nano
FROM {p}post a JOIN {p}post b ON a.namespace = b.namespace AND a.collection_key = b.collection_key
 AND a.block_id = b.block_id AND a.term = b.term AND a.pos < b.pos
GROUP BY ALL HAVING round(sum(a.w * b.w) * 1e9) >= {to_nano(params.min_similarity)}""",
        f"{p}cent": f"""
SELECT {block}, pos, CAST(sum(sim_nano) AS BIGINT) AS centricity_nano
FROM (SELECT {block}, a AS pos, sim_nano FROM {p}pairs
      UNION ALL SELECT {block}, b, sim_nano FROM {p}pairs) GROUP BY ALL""",
        f"{p}lead": f"""
SELECT {block}, b AS pos,
       CASE WHEN max(sim_nano) >= {to_nano(params.reassign_similarity)}
            THEN arg_max(a, (sim_nano, a)) ELSE min(a) END AS leader_pos,
       CASE WHEN max(sim_nano) >= {to_nano(params.reassign_similarity)}
            THEN max(sim_nano) ELSE arg_min(sim_nano, a) END AS leader_nano
FROM {p}pairs GROUP BY {block}, b""",
        f"{p}scored": f"""
SELECT {block}, pos, doc_id, centricity_nano, leader_pos, leader_nano
FROM {p}blk LEFT JOIN {p}cent USING ({block}, pos) LEFT JOIN {p}lead USING ({block}, pos)""",
        f"{p}both": f"""
SELECT d.namespace, d.collection_key, d.block_id, d.pos, d.leader_pos, d.leader_nano,
       d.centricity_nano AS c, l.centricity_nano AS lc,
       (l.centricity_nano, -l.pos) > (d.centricity_nano, -d.pos) AS up
FROM {p}scored d JOIN {p}scored l ON d.namespace = l.namespace
 AND d.collection_key = l.collection_key AND d.block_id = l.block_id AND d.leader_pos = l.pos""",
        f"{p}turned": f"""
SELECT {block}, leader_pos AS pos, arg_max(pos, (c, -pos)) AS parent_pos,
       arg_max(leader_nano, (c, -pos)) AS parent_nano
FROM {p}both WHERE NOT up GROUP BY {block}, leader_pos""",
        f"{p}edges": f"""
SELECT {block}, pos, parent_pos, parent_nano FROM {p}turned
UNION ALL
SELECT {block}, pos, leader_pos, leader_nano FROM {p}both
WHERE up AND NOT EXISTS (SELECT 1 FROM {p}turned t WHERE t.namespace = {p}both.namespace
 AND t.collection_key = {p}both.collection_key AND t.block_id = {p}both.block_id
 AND t.pos = {p}both.pos)""",
        f"walk_{p}": f"""
SELECT {block}, pos, pos AS root FROM (
  SELECT {block}, parent_pos AS pos FROM {p}edges
  EXCEPT SELECT {block}, pos FROM {p}edges)
UNION ALL
SELECT e.namespace, e.collection_key, e.block_id, e.pos, r.root
FROM walk_{p} r JOIN {p}edges e ON e.namespace = r.namespace
 AND e.collection_key = r.collection_key AND e.block_id = r.block_id AND e.parent_pos = r.pos""",
        f"{p}members": f"""
SELECT r.namespace, r.collection_key, r.block_id, r.root AS medoid_pos, m.doc_id AS medoid_id,
       m.centricity_nano AS medoid_centricity, r.pos, d.doc_id,
       CASE WHEN r.pos = r.root THEN 1.0 ELSE e.parent_nano / 1e9 END AS similarity,
       r.pos = r.root AS is_medoid
FROM walk_{p} r
JOIN {p}scored d ON d.namespace = r.namespace AND d.collection_key = r.collection_key
 AND d.block_id = r.block_id AND d.pos = r.pos
JOIN {p}scored m ON m.namespace = r.namespace AND m.collection_key = r.collection_key
 AND m.block_id = r.block_id AND m.pos = r.root
LEFT JOIN {p}edges e ON e.namespace = r.namespace AND e.collection_key = r.collection_key
 AND e.block_id = r.block_id AND e.pos = r.pos""",
    }


def one_pass(query: str, params: Params = ONE_BLOCK, upto: str = "members") -> str:
    """``query`` over the CTEs of one pass, named ``p_…``, as far as they are needed."""
    ctes = vector_ctes(params) | pass_ctes("p_", "vec", params)
    names = list(ctes)
    return with_ctes({n: ctes[n] for n in names[: names.index(f"p_{upto}") + 1]}, query, True)


def in_tiles(query: str, params: Params = CUT, docs: str = DOCS, more: dict[str, str] | None = None) -> str:
    """``query`` over the CTEs of one pass as far as blocks, and ``p_tiles``."""
    ctes = vector_ctes(params) | pass_ctes("p_", "vec", params)
    upto = list(ctes).index("p_post") + 1
    ctes = dict(list(ctes.items())[:upto])
    least = -(-params.tile_terms // params.tile_docs)
    ctes["p_cost"] = f"""
SELECT {KEYS}, block_id, pos, n_terms, least(greatest(n_terms, {least}), {params.tile_terms}) AS cost
FROM p_blk JOIN p_elig USING ({KEYS}, doc_id)"""
    ctes["p_tiles"] = f"""
SELECT {KEYS}, block_id, pos, n_terms, CAST(coalesce(sum(cost) OVER (PARTITION BY {KEYS}, block_id ORDER BY pos
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {params.tile_terms} AS INT) AS tile FROM p_cost"""
    return with_ctes({**ctes, "docs": docs, **(more or {})}, query)


def two_passes(query: str, params: Params = SMALL_BLOCKS, more: dict[str, str] | None = None) -> str:
    """Blocks (``b_…``), rest (``r_…``) and both together (``stage1``)."""
    ctes = vector_ctes(params) | pass_ctes("b_", "vec", params)
    ctes["rest_vec"] = f"""
SELECT v.* FROM vec v JOIN b_scored s USING ({KEYS}, doc_id) WHERE s.centricity_nano IS NULL"""
    ctes |= pass_ctes("r_", "rest_vec", params)
    ctes["stage1"] = "SELECT 0 AS pass, * FROM b_members UNION ALL SELECT 1, * FROM r_members"
    return with_ctes(ctes | (more or {}), query, True)


def merged(
    query: str, params: Params = SMALL_BLOCKS, more: dict[str, str] | None = None
) -> str:
    ctes = {
        "medoid_vec": f"""
SELECT v.*, s.pass, s.block_id AS home, s.medoid_centricity AS c, -s.pos AS minus_pos
FROM vec v JOIN stage1 s USING ({KEYS}, doc_id) WHERE s.is_medoid"""
    }
    ctes |= pass_ctes("m_", "medoid_vec", params, "(pass, home, c, minus_pos)")
    keep = "WHERE meta_id IS NOT NULL OR heads = 1" if params.drop_unmerged else ""
    ctes["joined"] = f"""
SELECT s.namespace, s.collection_key, s.medoid_id, s.doc_id, s.similarity, s.is_medoid,
       m.medoid_id AS meta_id, m.similarity AS meta_similarity,
       count(*) FILTER (s.is_medoid) OVER (PARTITION BY s.namespace, s.collection_key) AS heads
FROM stage1 s LEFT JOIN m_members m ON m.namespace = s.namespace
 AND m.collection_key = s.collection_key AND m.doc_id = s.medoid_id"""
    ctes["merged"] = f"""
SELECT {KEYS}, coalesce(meta_id, medoid_id) AS label, doc_id,
       CASE WHEN is_medoid AND coalesce(meta_id, medoid_id) <> medoid_id
            THEN meta_similarity ELSE similarity END AS similarity,
       is_medoid AND coalesce(meta_id, medoid_id) = medoid_id AS is_medoid
FROM joined {keep}"""
    return two_passes(query, params, ctes | (more or {}))


def metrics_sql(p: str, name: str, params: Params = SMALL_BLOCKS) -> str:
    at = to_nano(params.reassign_similarity)
    block = f"{KEYS}, block_id"
    return f"""
SELECT '{name}' AS pass, (SELECT count(*) FROM {p}scored) AS documents,
  (SELECT count(*) FROM {p}scored WHERE centricity_nano IS NOT NULL) AS used,
  (SELECT count(*) FROM (SELECT {block}, pos FROM {p}edges INTERSECT SELECT {block}, parent_pos FROM {p}edges)) AS splices,
  (SELECT CAST(coalesce(sum((n > 1 AND sim_nano >= {at} AND sim_nano >= top)::BIGINT), 0) AS BIGINT) FROM (
    SELECT sim_nano, row_number() OVER w AS n, max(sim_nano) OVER w AS top FROM {p}pairs
    WINDOW w AS (PARTITION BY {block}, b ORDER BY a))) AS reassigned"""


LIST_ORDER = "pass, block_id, medoid_centricity, medoid_pos DESC"


def ranked(order: str) -> str:
    return two_passes(
        f"""
SELECT {KEYS}, medoid_id, size, row_number() OVER (PARTITION BY {KEYS} ORDER BY {order}) AS rank
FROM (SELECT {KEYS}, pass, block_id, medoid_id, medoid_centricity, medoid_pos,
             count(*) - 1 AS size FROM stage1 GROUP BY ALL)"""
    )


MEMBERS = f"SELECT {KEYS}, medoid_id AS label, doc_id, similarity, is_medoid FROM p_members"


# Histograms


def histogram_sql(
    rows: str,
    bounds: tuple[float, ...],
    prior: tuple[int, ...] | None = None,
    by: str = "",
) -> str:
    """``rows`` has the columns ``v`` and ``times`` and those named in ``by``."""
    earlier = prior or (0,) * len(bounds)
    lead = f"{by}, " if by else ""
    steps = ", ".join(
        f"({i}, CAST({b} AS DOUBLE), "
        f"CAST({bounds[i + 1] if i + 1 < len(bounds) else repr('Infinity')} AS DOUBLE), {earlier[i]})"
        for i, b in enumerate(bounds)
    )
    last_bucket = len(bounds) - 1
    using = f"USING ({by})" if by else "ON true"
    return f"""
WITH rows AS ({rows}),
steps(bucket_idx, left_bound, right_bound, earlier) AS (VALUES {steps}),
heads AS (SELECT {lead}sum(times) + {sum(earlier)} AS n,
          coalesce(sum(times) FILTER (v < {bounds[0]}), 0) AS below FROM rows
          {f'GROUP BY {by}' if by else ''}),
counted AS (SELECT {lead}bucket_idx, sum(times) AS c FROM rows
  JOIN steps ON v >= left_bound AND (v < right_bound OR bucket_idx = {last_bucket})
  GROUP BY {lead}bucket_idx)
SELECT {lead}CAST(bucket_idx AS INT) AS bucket_idx, left_bound,
       CAST(coalesce(c, 0) + earlier AS BIGINT) AS count,
       CASE WHEN n = 0 THEN 0.0 ELSE CAST(coalesce(c, 0) + earlier AS DOUBLE) / CAST(n AS DOUBLE) END
         AS portion, CAST(n AS BIGINT) AS n, CAST(below AS BIGINT) AS below
FROM heads CROSS JOIN steps LEFT JOIN counted USING ({lead}bucket_idx)"""


EVENT_VALUES = "SELECT event_type, value AS v, 1 AS times FROM events"
LINEAR_BY_TYPE = histogram_sql(EVENT_VALUES, LINEAR, by="event_type")

DOCUMENT_KEY = "namespace || '/' || collection_key || '/' ||"
CLUSTER_KEY = "'DEFAULT/' || namespace || '/' || collection_key || '/' ||"

REASSIGNMENTS = one_pass(
    f"""
SELECT {KEYS}, block_id, b, CAST(sum(CASE WHEN n > 1 AND sim_nano >= {to_nano(0.3)}
   AND sim_nano >= f AND sim_nano >= coalesce(best, 0) THEN 1 ELSE 0 END) AS BIGINT)
   AS reassigned
FROM (SELECT {KEYS}, block_id, b, sim_nano, row_number() OVER w AS n,
    first_value(sim_nano) OVER w AS f,
    max(CASE WHEN sim_nano >= {to_nano(0.3)} THEN sim_nano END) OVER
      (PARTITION BY {KEYS}, block_id, b ORDER BY a
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
  FROM p_pairs WINDOW w AS (PARTITION BY {KEYS}, block_id, b ORDER BY a))
GROUP BY {KEYS}, block_id, b""",
    upto="pairs",
)

ORACLE: dict[str, str] = {
    "tsv_roundtrip": PLAIN_OPINIONS,
    "conform_rows": f"""
SELECT doc_id, {', '.join(f'f[{i}] AS {n}' for i, n in enumerate(FIELDS, 1))}
FROM (SELECT doc_id, string_split(text, chr(10)) AS f FROM documents) WHERE len(f) = 11""",
    "collection_keys": f"""
SELECT id, product || ':' || '-' || type || '/' || locale || '.' AS collection_key
FROM ({OPINIONS})""",
    "fan_out": FAN_OUT,
    "imported_documents": FAN_OUT,
    "collection_sizes": SIZES,
    "streamed_collections": SIZES,
    "running_collection_sizes": f"SELECT {KEYS}, size FROM ({SIZES})",
    "running_distinct_sizes": f"""
SELECT {KEYS}, count(DISTINCT doc_id) AS size FROM (
  SELECT {KEYS}, doc_id FROM ({FAN_OUT})
  UNION ALL
  SELECT 'demo', unnest([locale, product || ':' || locale, type || '-' || locale]), id FROM ({OPINIONS}) WHERE length(id) % 2 = 0)
GROUP BY ALL""",
    "import_counters": f"""
SELECT count(*) FILTER (length(text) > 0) AS rows_used,
       count(*) FILTER (length(text) = 0) AS rows_discarded,
       3 * count(*) FILTER (length(text) > 0) AS docs_created,
       (SELECT count(DISTINCT collection_key) FROM ({FAN_OUT})) AS collections_created
FROM ({OPINIONS})""",
    "import_counters_of_files": f"""
SELECT count(*) FILTER (length(text) > 0) AS rows_used,
       count(*) FILTER (length(text) = 0) AS rows_discarded,
       2 * count(*) AS rows_rejected,
       3 * count(*) FILTER (length(text) > 0) AS docs_created,
       (SELECT count(DISTINCT collection_key) FROM ({FAN_OUT})) AS collections_created
FROM ({OPINIONS})""",
    "export_counter": "SELECT count(*) AS exported FROM documents",
    "latest_documents": """
SELECT 'demo' AS namespace, 'chat' AS collection_key, conv_id AS doc_id,
       arg_max(text, turn) AS text, count(*) AS copies FROM conversations GROUP BY conv_id""",
    "scan_collection": f"""
SELECT {KEYS}, CAST(doc_id AS VARCHAR) AS doc_id, text FROM ({DOCS}) WHERE collection_key = 'en'""",
    "export_documents": DOCS,
    "collections_merge": STATE,
    "collection_state": f"SELECT * FROM ({STATE}) "
    "WHERE coalesce(size, modified_ms, rebuilt_ms, processed_ms) IS NOT NULL",
    "imports_of_two_namespaces": two_namespaces(2),
    "two_streams": two_namespaces(1),
    "stream_after_batch": f"""
SELECT 'texts' AS namespace, lang AS collection_key, CAST(doc_id AS VARCHAR) AS doc_id,
       CASE WHEN doc_id % 2 = 0 THEN 'new ' || text ELSE text END AS text,
       count(*) OVER c + count(*) FILTER (doc_id % 2 = 0) OVER c AS size,
       {NOW_MS} + CASE WHEN count(*) FILTER (doc_id % 2 = 0) OVER c > 0 THEN 5 ELSE 0 END AS modified_ms
FROM documents WHERE length(text) > 0 WINDOW c AS (PARTITION BY lang)""",
    "stream_counters": f"""
SELECT CAST(count(*) FILTER (length(text) > 0) AS BIGINT) AS rows_used,
       CAST(count(*) FILTER (length(text) = 0) AS BIGINT) AS rows_discarded,
       CAST(2 * count(*) AS BIGINT) AS rows_rejected,
       CAST(3 * count(*) FILTER (length(text) > 0) AS BIGINT) AS docs_created
FROM ({OPINIONS})""",
    "null_field_keys": f"""
SELECT 'demo' AS namespace, CASE WHEN product <> 'chat' THEN product ELSE '' END || '-' || locale
       AS collection_key, id AS doc_id FROM ({OPINIONS}) WHERE length(text) > 0""",
    "lookup_hot_and_cold": """
WITH d AS (
  SELECT repeat('k', 300) || lang AS key, doc_id FROM documents
  UNION ALL
  SELECT repeat('k', 300) || lang || doc_id, doc_id FROM documents WHERE doc_id % 50 = 0
)
SELECT key, doc_id, min(doc_id) OVER (PARTITION BY key) AS first_id FROM d""",
    "list_documents": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents "
    "WHERE lang = 'de' AND length(text) > 0",
    "rejected_records": "SELECT doc_id, len(string_split(text, chr(10))) AS n_fields FROM documents "
    "WHERE len(string_split(text, chr(10))) <> 11",
    "stale_collections": f"""
SELECT * FROM ({STATE})
WHERE modified_ms IS NOT NULL AND (rebuilt_ms IS NULL OR rebuilt_ms <= modified_ms)""",
    "storage_keys": f"""
SELECT doc_id, namespace || '/' || collection_key AS collection,
       {DOCUMENT_KEY} '' AS document_prefix,
       {DOCUMENT_KEY} doc_id AS document_simple,
       {CLUSTER_KEY} '{NOW_MS}/' || doc_id AS cluster_simple,
       {CLUSTER_KEY} '{NOW_MS}/' AS cluster_prefix_simple,
       {DOCUMENT_KEY} reverse(CAST(doc_id AS VARCHAR)) AS document_reverse_parts,
       {CLUSTER_KEY} reverse('{NOW_MS}') || '/' || doc_id AS cluster_reverse_parts,
       {CLUSTER_KEY} reverse('{NOW_MS}') || '/' AS cluster_prefix_reverse_parts
FROM ({DOCS})""",
    "run_slugs": f"""
SELECT DISTINCT {KEYS}, 'runs/{NOW_MS}/' || left(md5(namespace), 8) || '_' ||
       left(md5(collection_key), 8) || '/vectorize' AS path FROM ({FAN_OUT})""",
    "tokens": with_ctes(vector_ctes(), f"SELECT {KEYS}, doc_id, CAST(place AS INT) AS place, term FROM tok"),
    "term_freq": with_ctes(vector_ctes(), "SELECT * FROM tf"),
    "collocations": with_ctes(
        gram_ctes(), f"SELECT {KEYS}, n, head, tail, c AS count, round(llr, 4) AS llr FROM kept"
    ),
    "term_freq_bigrams": with_ctes(gram_ctes(), "SELECT * FROM tf"),
    "dictionary_with_phrases": with_ctes(gram_ctes(), "SELECT * FROM dict"),
    "dictionary_clamped": with_ctes(vector_ctes(CLAMPED), "SELECT * FROM dict"),
    "tfidf_clamped": with_ctes(
        vector_ctes(CLAMPED), f"SELECT {KEYS}, doc_id, term, round(weight, 6) AS weight FROM weighted"
    ),
    "dictionary": with_ctes(vector_ctes(), "SELECT * FROM dict"),
    "tfidf_weights": with_ctes(
        vector_ctes(), f"SELECT {KEYS}, doc_id, term, round(weight, 6) AS weight FROM weighted"
    ),
    "tfidf_normalized": with_ctes(
        vector_ctes(), f"SELECT {KEYS}, doc_id, term, round(w, 6) AS weight FROM vec"
    ),
    "vectors_exported": with_ctes(
        vector_ctes(), f"SELECT {KEYS}, doc_id, term, round(w, 6) AS weight FROM vec"
    ),
    "eligible_docs": one_pass(f"SELECT {KEYS}, doc_id, CAST(n_terms AS INT) AS n_terms FROM p_elig", upto="elig"),
    "doc_blocks": one_pass(
        f"SELECT {KEYS}, doc_id, block_id, pos, block_docs FROM p_blk", SMALL_BLOCKS, "blk"
    ),
    "similar_pairs": one_pass("SELECT * FROM p_pairs", upto="pairs"),
    "centricity": one_pass(
        f"SELECT {KEYS}, doc_id, centricity_nano FROM p_scored WHERE centricity_nano IS NOT NULL",
        WHOLE,
        upto="scored",
    ),
    "leaders": one_pass(
        f"SELECT {KEYS}, doc_id, leader_pos, leader_nano FROM p_scored "
        "WHERE leader_pos IS NOT NULL",
        WHOLE,
        upto="scored",
    ),
    "reassignments": REASSIGNMENTS,
    "reassignments_in_tiles": REASSIGNMENTS,
    "tile_sizes": in_tiles(
        f"SELECT {KEYS}, block_id, tile, min(pos) AS first, count(*) AS n_docs, "
        "CAST(sum(n_terms) AS BIGINT) AS n_terms FROM p_tiles GROUP BY ALL"
    ),
    "tile_bounds": in_tiles(
        f"""
SELECT a.namespace, a.collection_key, a.block_id, a.tile AS low, b.tile AS high,
       round(coalesce(sum(x.top * y.top), 0), 6) AS bound,
       coalesce(sum(x.top * y.top), 0) < {CUT.min_similarity} AS skipped
FROM tiles a JOIN tiles b ON a.block_id = b.block_id AND a.tile < b.tile
JOIN tops x ON x.block_id = a.block_id AND x.tile = a.tile
LEFT JOIN tops y ON y.block_id = b.block_id AND y.tile = b.tile AND y.term = x.term
GROUP BY ALL""",
        docs=DOCS.replace("lang AS collection_key, doc_id", "'all' AS collection_key, lang || '-' || doc_id AS doc_id"),
        more={
            "tiles": f"SELECT DISTINCT {KEYS}, block_id, tile FROM p_tiles",
            "tops": f"""
SELECT block_id, tile, term, max(w) AS top FROM p_post JOIN p_tiles USING ({KEYS}, block_id, pos) GROUP BY ALL""",
        },
    ),
    "medoid_rank": one_pass(
        f"""
SELECT {KEYS}, doc_id, CAST(row_number() OVER (PARTITION BY {KEYS}, block_id
       ORDER BY centricity_nano, pos DESC) AS INT) AS rank
FROM p_scored WHERE centricity_nano IS NOT NULL""",
        upto="scored",
    ),
    "directed_edges": one_pass("SELECT * FROM p_edges", upto="edges"),
    "cluster_members": one_pass(MEMBERS, WHOLE),
    "clusters_in_tiles": one_pass(MEMBERS),
    "clusters_without_blocks": one_pass(MEMBERS, WITHOUT_BLOCKS),
    "near_copies": one_pass(MEMBERS, CLOSE),
    "unassigned": one_pass(
        f"""
SELECT {KEYS}, block_id, doc_id,
       CASE WHEN centricity_nano IS NULL THEN 'rest' ELSE 'outranked' END AS reason
FROM p_scored ANTI JOIN p_members USING ({KEYS}, block_id, pos)""",
        WHOLE,
    ),
    "splices": one_pass(
        f"""
SELECT {KEYS}, block_id, count(*) FILTER (inner_node) AS splices FROM (
  SELECT {KEYS}, block_id, pos, EXISTS (SELECT 1 FROM p_edges e WHERE e.namespace = s.namespace
    AND e.collection_key = s.collection_key AND e.block_id = s.block_id AND e.pos = s.pos)
   AND EXISTS (SELECT 1 FROM p_edges e WHERE e.namespace = s.namespace
    AND e.collection_key = s.collection_key AND e.block_id = s.block_id
    AND e.parent_pos = s.pos) AS inner_node
  FROM p_scored s) GROUP BY {KEYS}, block_id""",
        SMALL_BLOCKS,
    ),
    "rest_documents": one_pass(
        f"SELECT {KEYS}, block_id, doc_id FROM p_scored WHERE centricity_nano IS NULL",
        SMALL_BLOCKS,
        "scored",
    ),
    "rest_clusters": two_passes(f"SELECT {KEYS}, medoid_id, doc_id, similarity FROM r_members"),
    "stage1_clusters": two_passes(
        f"SELECT {KEYS}, pass, block_id, medoid_id, doc_id, similarity, is_medoid FROM stage1"
    ),
    "cluster_sizes": two_passes(
        f"SELECT {KEYS}, pass, block_id, medoid_id, count(*) - 1 AS size FROM stage1 GROUP BY ALL"
    ),
    "clusters_ranked": ranked(LIST_ORDER),
    "clusters_by_size": ranked(f"size DESC, {LIST_ORDER}"),
    "medoid_similarities": merged(
        f"""
SELECT m.*, CASE WHEN m.is_medoid THEN 1.0 ELSE coalesce(s, 0) END AS medoid_similarity
FROM merged m LEFT JOIN (
  SELECT a.namespace, a.collection_key, a.label, a.doc_id, round(sum(a.w * b.w) * 1e9) / 1e9 AS s
  FROM of_members a JOIN of_medoids b ON a.namespace = b.namespace
   AND a.collection_key = b.collection_key AND a.label = b.label AND a.term = b.term
  GROUP BY ALL) USING ({KEYS}, label, doc_id)""",
        more={
            "of_members": f"""
SELECT {KEYS}, label, doc_id, is_medoid, term, w FROM merged JOIN vec USING ({KEYS}, doc_id)""",
            "of_medoids": f"SELECT {KEYS}, label, term, w FROM of_members WHERE is_medoid",
        },
    ),
    "rebuild_metrics": merged(
        " UNION ALL ".join(metrics_sql(p, n) for p, n in (("b_", "blocks"), ("r_", "rest"), ("m_", "medoids")))
    ),
    "cluster_labels": merged(
        f"""
SELECT {KEYS}, label, term, score, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEYS}, label ORDER BY score DESC, term) AS rank FROM (
    SELECT {KEYS}, label, term, round({ratio_sql('k', '(size - k)', '(df - k)', '(n_docs - size - df + k)')}, 6) AS score
    FROM of_clusters JOIN dict USING ({KEYS}, term) WHERE k * n_docs > df * size))
WHERE rank <= 5""",
        more={
            "of_clusters": f"""
SELECT {KEYS}, label, term, count(*) AS k, any_value(size) AS size
FROM (SELECT *, count(*) OVER (PARTITION BY {KEYS}, label) AS size FROM merged) JOIN vec USING ({KEYS}, doc_id)
GROUP BY {KEYS}, label, term"""
        },
    ),
    "merged_clusters": merged("SELECT * FROM merged"),
    "merged_only": merged(
        "SELECT * FROM merged", Params(block_size=SMALL_BLOCKS.block_size, drop_unmerged=True)
    ),
    "cluster_size_histogram": two_passes(
        "SELECT * FROM bins",
        more={
            "bins": histogram_sql(
                f"SELECT {KEYS}, count(*) - 1 AS v, count(*) - 1 AS times FROM stage1 "
                f"GROUP BY {KEYS}, pass, block_id, medoid_id",
                LOG_BOUNDS,
                by=KEYS,
            )
        },
    ),
    "histogram_log": histogram_sql(EVENT_VALUES, LOG_BOUNDS, by="event_type"),
    "histogram_linear": histogram_sql(EVENT_VALUES, LINEAR),
    "histogram_custom": histogram_sql(
        "SELECT value AS v, user_id AS times FROM events", CUSTOM, PRIOR
    ),
    "histogram_merged": histogram_sql(
        "SELECT value AS v, 1 AS times FROM events "
        "UNION ALL SELECT CAST(n_chars AS DOUBLE), 1 FROM documents",
        LOG_BOUNDS,
    ),
    "histogram_summary": f"""
SELECT event_type, max(n) AS n, max(below) AS below, count(*) AS k, min(left_bound) AS left,
       max(left_bound) AS right, arg_max(bucket_idx, (count, -bucket_idx)) AS max_index
FROM ({LINEAR_BY_TYPE}) GROUP BY event_type""",
}


def _active(rebuild_ms: int) -> str:
    """Doc ids are strings in the store, so their order is that of strings."""
    sql = merged(
        f"SELECT {KEYS}, CAST({rebuild_ms} AS BIGINT) AS rebuild_ms, label, doc_id, similarity, "
        "is_medoid FROM merged"
    )
    return sql.replace(DOCS, DOCS.replace("doc_id", "CAST(doc_id AS VARCHAR) AS doc_id"))


ORACLE["active_clusters"] = _active(NOW_MS + 1)
ORACLE["rebuild_twice"] = _active(NOW_MS)
