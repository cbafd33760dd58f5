"""The queries opN_<name>, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from tidewatch.llm import decontamination, exact_dedup, lexical_search, lm_scoring, mixing, near_join, packing, prefix_trie, quality, sharding, substring_dedup, toxicity, url_filter
from tidewatch.llm.shared import table


def op1_sharding(spark, sf_dir):
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=40)


def op2_quality(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10).drop("text", "spans")


def op4_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op5_lm_scoring(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lm_scoring.score(table(spark, sf_dir, "documents"), good)


def op6_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, weights=(5, 2, 1), share=1.5, epochs=2).select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, table(spark, sf_dir, "labels")).drop("text")


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), window=20).drop("kept")


def op10_near_join(spark, sf_dir):
    return near_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_copies", "n_links")


def op11_packing(spark, sf_dir):
    tokenizer, ranks = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer, ranks, end_id=2, size=1024)


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.build(table(spark, sf_dir, "conversations"))


def op13_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_decontamination": op3_decontamination,
    "op4_url_filter": op4_url_filter,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_near_join": op10_near_join,
    "op11_packing": op11_packing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES = {
    "op3_decontamination": """
        WITH d AS (
            SELECT doc_id, regexp_extract_all(lower_az, '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words
            FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)
        ), b AS (
            SELECT item_id, regexp_extract_all(lower_az, '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words
            FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)
        ), bw AS (
            SELECT DISTINCT item_id, least(len(words), 10) AS k, array_to_string(list_slice(words, pos, pos + 9), ' ') AS h
            FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) AS pos FROM b WHERE len(words) > 0)
        ), sizes AS (SELECT DISTINCT k FROM bw),
        dw AS (
            SELECT doc_id, pos, k, array_to_string(list_slice(words, pos, pos + k - 1), ' ') AS h
            FROM (SELECT doc_id, words, k, unnest(range(1, greatest(len(words) - k + 2, 1))) AS pos FROM d, sizes)
        ), m AS (SELECT dw.doc_id, dw.pos, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.h = bw.h),
        hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + k)) AS place FROM m) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
    """,
    "op6_mixing": """
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS k FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w FROM d GROUP BY source
        ), f AS (
            SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS goal, sum(w) OVER () AS ws,
                coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0) AS cb, coalesce(sum(w) OVER o, 0) AS wb
            FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), g AS (
            SELECT *, w * ((goal - cb) / (ws - wb)) >= cap AS isfull FROM f
        ), t AS (
            SELECT source, source_size, CASE WHEN isfull THEN cap ELSE w * ((goal - sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER ()) / (ws - sum(CASE WHEN isfull THEN w ELSE 0 END) OVER ())) END AS target FROM g
        ), r AS (
            SELECT d.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
                CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
            CAST(CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - start_at)) ELSE 0 END AS BIGINT) AS taken
        FROM r
    """,
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
    """,
    "op9_substring_dedup": """
        WITH w AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
        ), starts AS (
            SELECT doc_id, unnest(range(1, greatest(len(words) - 18, 1))) AS pos, words FROM w
        ), windows AS (
            SELECT doc_id, pos, md5(array_to_string(list_slice(words, pos, pos + 19), ' ')) AS h FROM starts
        ), ranked AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k FROM windows
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS place FROM ranked WHERE k > 1
        ), lost AS (
            SELECT doc_id, list(place) AS places, count(*) AS n FROM gone GROUP BY doc_id
        ), placed AS (
            SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM w
        ), kept AS (
            SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.place) AS body
            FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.place = g.place GROUP BY p.doc_id
        )
        SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(l.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
        FROM w LEFT JOIN lost l ON w.doc_id = l.doc_id LEFT JOIN kept k ON w.doc_id = k.doc_id
    """,
    # crc32 is spelled out: bits of each digit, by the reflected polynomial 0xEDB88320
    "op12_prefix_trie": """
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY pos) AS turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
                lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 4 AS h FROM t GROUP BY conv_id
        ), r AS (
            SELECT o.conv_id, list_concat(CASE WHEN b.turns IS NULL THEN [] ELSE b.turns[1:o.h] END, o.turns[o.h + 1:]) AS turns FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
        ), p AS (
            SELECT conv_id, len(turns) AS n, d AS depth, sha256(CAST(turns[1:d] AS VARCHAR)) AS node, sha256(CAST(turns[1:d - 1] AS VARCHAR)) AS parent, CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words
            FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)
        ), nodes AS (
            SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, string_agg(CASE WHEN n = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM p GROUP BY depth, node
        ), kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
        full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.depth = k.depth AND n.node = k.node),
        under AS (
            SELECT a.depth, a.node, sum((f.n_convs - 1) * f.words) AS saved, count(*) FILTER (f.n_children = 0) AS leaves
            FROM full_nodes f JOIN p a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY a.depth, a.node
        )
        SELECT f.conv_id, f.depth, CASE WHEN f.depth > 0 THEN up.conv_id END AS parent_conv_id, f.n_convs, f.n_children, CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
        FROM full_nodes f JOIN under u ON u.depth = f.depth AND u.node = f.node LEFT JOIN nodes up ON up.depth = f.depth - 1 AND up.node = f.parent
    """,
    "op13_lexical_search": """
        WITH d AS (
            SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS terms FROM documents
        ), b AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM benchmark
        ), total AS (SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d),
        tf AS (
            SELECT k, doc_id, size, term, count(*) AS tf FROM (SELECT k, doc_id, len(terms) AS size, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY ALL
        ), w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, total GROUP BY term, n),
        s AS (
            SELECT item_id, k, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * size * n) // l)))) AS BIGINT) AS score FROM tf JOIN b USING (term) JOIN w USING (term), total GROUP BY ALL
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, k) AS INT) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """,
}
