"""The registered queries in SQL, over the raw tables.

Written apart from the operators and in other terms where there is a choice: islands by
window for tag spans, interval self joins for clusters and hierarchies, list folds for
the greedy choice.  ``VIEWS`` are common table expressions; each statement gets the
views it names, and theirs."""

from __future__ import annotations

import re

K = "doc_id, sent_ix"


def _dist(a: str, b: str, metric: str) -> str:
    return f"list_distance({a}, {b})" if metric == "euclidean" else f"list_cosine_distance({a}, {b})"


def _split(col: str) -> str:
    return f"CASE WHEN {col} % 10 < 8 THEN 'train' WHEN {col} % 10 = 8 THEN 'validation' ELSE 'test' END"


def _h60(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15) AS BIGINT)"


def _islands(source: str, tag: str, keys: str) -> str:
    return f"""
    SELECT {keys}, CAST(min(tok_ix) AS INTEGER) s, CAST(max(tok_ix) + 1 AS INTEGER) e,
           substr(arg_min({tag}, tok_ix), 3) label
    FROM (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END)
                    OVER (PARTITION BY {keys} ORDER BY tok_ix ROWS UNBOUNDED PRECEDING) island
          FROM (SELECT *, {tag}[1:2] = 'B-' OR ({tag}[1:2] = 'I-' AND coalesce(
                          lag({tag}) OVER (PARTITION BY {keys} ORDER BY tok_ix), 'O')[1:2]
                          NOT IN ('B-', 'I-')) opens
                FROM {source}))
    WHERE {tag}[1:2] IN ('B-', 'I-')
    GROUP BY {keys}, island"""


def _chain(source: str, keys: str) -> str:
    """Merges of gap rows (keys, ix, d, n_gaps)."""
    on = " AND ".join(f"b.{k} = a.{k}" for k in keys.split(", "))
    qualified = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""
    SELECT {qualified}, CAST(coalesce(max(b.ix) FILTER (b.ix < a.ix AND b.d > a.d) + 1, 0) AS INTEGER) s,
           CAST(coalesce(min(b.ix) FILTER (b.ix > a.ix AND b.d >= a.d), any_value(a.n_gaps)) AS INTEGER) e
    FROM {source} a JOIN {source} b ON {on}
    GROUP BY {qualified}, a.ix"""


VIEWS: dict[str, str] = {
    "pieces": """
    SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) sent_ix, unnest(p) piece
    FROM (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) p FROM documents)""",
    "all_sentences": f"""
    SELECT {K}, list_filter(string_split(piece, ' '), lambda w: w <> '') tokens FROM pieces""",
    "sentences": f"SELECT {K}, tokens, len(tokens) n FROM all_sentences WHERE len(tokens) > 0",
    "words": f"""
    SELECT {K}, n, CAST(generate_subscripts(tokens, 1) - 1 AS INTEGER) tok_ix, unnest(tokens) w
    FROM sentences""",
    "tagged": """
    SELECT *, CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'B-T' || (length(w) % 3)
                   WHEN length(w) <= 3 THEN 'O' ELSE 'I-T' || (length(w) % 3) END tag
    FROM words""",
    "chunk_tagged": """
    SELECT *, CASE WHEN regexp_matches(w, '^[A-Z]') OR length(w) % 4 = 0 THEN 'B-'
                   WHEN length(w) <= 2 THEN 'O' ELSE 'I-' END
              || CASE WHEN NOT regexp_matches(w, '^[A-Z]') AND length(w) % 4 <> 0 AND length(w) <= 2
                      THEN '' WHEN length(w) % 2 = 0 THEN 'NP' ELSE 'VP' END tag
    FROM words""",
    "named_flat": _islands("tagged", "tag", K),
    "chunks": _islands("chunk_tagged", "tag", K),
    # gold spans, end exclusive, place in the list
    "gold": f"""
    SELECT {K}, s, e, label, CAST(ord AS INTEGER) ord FROM (
        SELECT {K}, s, e, CAST(label[2:] AS INTEGER) + 1 label,
               row_number() OVER (PARTITION BY {K} ORDER BY s) - 1 ord FROM named_flat
        UNION ALL
        SELECT {K}, 0, CAST(n AS INTEGER), CAST(1 + n % 3 AS INTEGER), coalesce(k, 0)
        FROM sentences LEFT JOIN (SELECT {K}, count(*) k FROM named_flat GROUP BY ALL) USING ({K})
        WHERE n >= 2)""",
    "gold_in": f"SELECT {K}, s, e - 1 e, label, ord FROM gold",
    "gaps": f"""
    SELECT * FROM (SELECT {K}, tok_ix ix, n - 1 n_gaps,
           CAST(abs(length(w) - length(lead(w) OVER (PARTITION BY {K} ORDER BY tok_ix))) AS DOUBLE) d
    FROM words) WHERE d IS NOT NULL""",
    "merges": _chain("gaps", K),
    "clusters": f"""
    SELECT {K}, s, e FROM merges UNION ALL SELECT {K}, tok_ix, tok_ix FROM words""",
    "logits": f"""
    SELECT *, [((s * 7 + e * 13 + doc_id * 3 + sent_ix * 5 + k * 11) % 17) / 4.0
               FOR k IN [0, 1, 2, 3]]::DOUBLE[] lg FROM clusters""",
    "probs": "SELECT *, list_transform(ex, lambda x: x / list_sum(ex)) p FROM (SELECT *, "
    "list_transform(lg, lambda x: exp(x - list_max(lg))) ex FROM logits)",
    "scored": f"""
    SELECT {K}, s, e, CAST(list_position(lg, list_max(lg)) - 1 AS INTEGER) label, list_max(p) conf
    FROM probs""",
    "kept": f"""
    SELECT {K}, unnest(list_reduce(list([[s, e, label]] ORDER BY -rc, s - e, s), lambda acc, x:
        CASE WHEN len(list_filter(acc, lambda k: (k[1] <= x[1][1] AND k[2] >= x[1][2])
                                              OR (k[1] >= x[1][1] AND k[2] <= x[1][2]))) > 0
             THEN acc ELSE list_concat(acc, x) END)) k
    FROM (SELECT *, round(conf, 9) rc FROM scored WHERE label <> 0) GROUP BY {K}""",
    "flat": f"SELECT {K}, k[1] s, k[2] e, k[3] label FROM kept",
    "predictions": f"""
    SELECT {K}, s, e, label FROM flat UNION ALL SELECT {K}, s, e, label FROM scored WHERE label = 0""",
    "sub": f"""
    SELECT {K}, n, list_concat(ids, list_transform(range((8 - len(ids) % 8) % 8), lambda x: -1)) word_ids
    FROM (SELECT {K}, any_value(n) n, flatten(list(list_transform(range(CAST(ceil(length(w) / 4.0) AS BIGINT)),
                 lambda x: tok_ix) ORDER BY tok_ix)) ids FROM words GROUP BY {K})""",
    "sub_rows": f"""
    SELECT {K}, CAST(generate_subscripts(word_ids, 1) - 1 AS INTEGER) tok, unnest(word_ids) word_id
    FROM sub""",
    "extents": f"""
    SELECT {K}, CAST(word_id AS INTEGER) word_id, min(tok) first_tok, max(tok) last_tok
    FROM sub_rows WHERE word_id >= 0 GROUP BY {K}, word_id""",
    "token_clusters": f"""
    SELECT c.doc_id, c.sent_ix, c.s, c.e, a.first_tok tok_s, b.last_tok tok_e, b.first_tok = b.last_tok one_token
    FROM clusters c
    JOIN extents a ON a.doc_id = c.doc_id AND a.sent_ix = c.sent_ix AND a.word_id = c.s
    JOIN extents b ON b.doc_id = c.doc_id AND b.sent_ix = c.sent_ix AND b.word_id = c.e""",
    "trees": f"""
    SELECT {K}, CASE WHEN n = 1 THEN '(TOP (NP ' || lv[1] || ')'
                ELSE '(TOP (S (NP ' || array_to_string(lv[1:n // 2], ' ') || ') (VP '
                     || array_to_string(lv[n // 2 + 1:], ' ') || '))' END
           || CASE WHEN (doc_id + sent_ix) % 50 = 0 THEN '' ELSE ')' END tree,
           (doc_id + sent_ix) % 50 = 0 broken, n, lv
    FROM (SELECT *, list_transform(tokens, lambda w: '(NN ' || replace(replace(w, '(', '-LRB-'), ')', '-RRB-')
                 || ')') lv FROM sentences)""",
    "events": f"""
    SELECT {K}, generate_subscripts(t, 1) - 1 pos, unnest(t) tok
    FROM (SELECT {K}, regexp_extract_all(tree, '[()]|[^\\s()]+') t FROM trees)""",
    "depths": f"""
    SELECT *, tok NOT IN ('(', ')') AND coalesce(prev, '') <> '(' is_leaf,
           sum(CASE tok WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END)
             OVER (PARTITION BY {K} ORDER BY pos ROWS UNBOUNDED PRECEDING) depth
    FROM (SELECT *, lag(tok) OVER (PARTITION BY {K} ORDER BY pos) prev,
                 lead(tok) OVER (PARTITION BY {K} ORDER BY pos) nxt FROM events)""",
    "bad_trees": f"""
    SELECT {K}, CASE WHEN arg_max(depth, pos) <> 0 OR min(depth) < 0 THEN 'unbalanced'
                     ELSE 'not_one_tree' END reason
    FROM depths GROUP BY {K}
    HAVING arg_max(depth, pos) <> 0 OR min(depth) < 0 OR arg_min(tok, pos) <> '('
        OR count(*) FILTER (depth = 0) <> 1""",
    "bank_labels": """
    SELECT * FROM (VALUES (0, 'O'), (1, 'S'), (2, 'NP'), (3, 'VP'), (4, 'TOP'), (5, 'NN'), (6, 'TOP+S'),
                          (7, 'NP+NN'), (8, 'VP+NN')) t(code, label)""",
    "joined_nodes": f"""
    SELECT {K}, s, e, string_agg(label, '+' ORDER BY pos) label FROM nodes GROUP BY {K}, s, e""",
    "nodes": f"""
    SELECT {K}, CAST(place - 1 AS INTEGER) pos, CAST(leaves AS INTEGER) s, CAST(close_leaves AS INTEGER) e,
           CASE WHEN nxt IN ('(', ')') THEN '' ELSE nxt END label
    FROM (SELECT *, lead(leaves) OVER (PARTITION BY {K}, level ORDER BY pos) close_leaves
          FROM (SELECT *, CASE tok WHEN '(' THEN depth ELSE depth + 1 END AS level,
                       count(*) FILTER (tok IN ('(', ')') OR is_leaf)
                         OVER (PARTITION BY {K} ORDER BY pos ROWS UNBOUNDED PRECEDING) place,
                       sum(CASE WHEN is_leaf THEN 1 ELSE 0 END)
                         OVER (PARTITION BY {K} ORDER BY pos ROWS UNBOUNDED PRECEDING) leaves
                FROM depths ANTI JOIN bad_trees USING ({K}))
          WHERE tok IN ('(', ')'))
    WHERE tok = '('""",
    "drawn": f"""
    SELECT {K}, CAST(ord AS INTEGER) ord, CAST(ix - e * (e + 1) // 2 AS INTEGER) s, CAST(e AS INTEGER) e
    FROM (SELECT *, CAST(floor((sqrt(8 * ix + 1) - 1) / 2) AS BIGINT) e
          FROM (SELECT {K}, k, ix, row_number() OVER (PARTITION BY {K} ORDER BY (y * y + a) % 2147483647, ix) - 1 ord
                FROM (SELECT *, (c * (ix % 2147483647) + d) % 2147483647 y
                      FROM (SELECT *, (lo + (x * x + c) % 2147483647 % (hi - lo) + o % total) % total ix
                            FROM (SELECT *, i * total // k lo, (i + 1) * total // k hi,
                                         (a * (i % 2147483647) + b) % 2147483647 x
                                  FROM (SELECT *, unnest(range(k)) i FROM sizes)))))
          WHERE ord < k)""",
    "sizes": f"""
    SELECT {K}, n * (n + 1) // 2 total, least(2 * n + 1, n * (n + 1) // 2) k, {_h60("'42'", "doc_id", "sent_ix", "'o'")} o,
           CAST('0x' || m[1:7] AS BIGINT) + 1 a, CAST('0x' || m[8:14] AS BIGINT) b,
           CAST('0x' || m[15:21] AS BIGINT) + 1 c, CAST('0x' || m[22:28] AS BIGINT) d
    FROM (SELECT *, md5(concat_ws(':', '42', doc_id, sent_ix)) m FROM sentences)""",
    "texts": f"SELECT {K}, array_to_string(tokens, ' ') txt FROM sentences",
    "tv": """
    SELECT vec_id // 16 sid, CAST(vec_id % 16 AS INTEGER) tok_ix, CAST((vec_id % 16) // 2 AS INTEGER) word_ix,
           vec_id // 64 batch_id, embedding::DOUBLE[] v, label FROM embeddings""",
    "tv_cells": """
    SELECT sid, tok_ix, word_ix, generate_subscripts(v, 1) - 1 dim, unnest(v) x FROM tv""",
    "pooled_cells": "SELECT sid, word_ix, dim, avg(x) x FROM tv_cells GROUP BY ALL",
    "pooled": "SELECT sid, word_ix, list(x ORDER BY dim) v FROM pooled_cells GROUP BY ALL",
    "proj_cells": """
    SELECT sid, tok_ix, word_ix, r dim,
           sum(t.x * ((r * 31 + t.dim * 17) % 13 - 6) / 8.0) + any_value(((r * 31 + 64 * 17) % 13 - 6) / 8.0) x
    FROM tv_cells t CROSS JOIN (SELECT unnest(range(128)) r) GROUP BY ALL""",
    "examples": """
    SELECT batch_id, sid, CAST(least(sid % 4, top) AS INTEGER) s,
           CAST(least(least(sid % 4, top) + sid % 17, top) AS INTEGER) e, CAST(sid % 3 AS INTEGER) label
    FROM (SELECT sid, max(batch_id) batch_id, max(tok_ix) top FROM tv GROUP BY sid)""",
    "tok_extents": "SELECT sid, word_ix, min(tok_ix) f, max(tok_ix) l FROM tv GROUP BY ALL",
    "vec_gaps": """
    SELECT *, max(ix) OVER (PARTITION BY sid) + 1 n_gaps FROM (
        SELECT sid, word_ix ix, round(list_distance(v, lead(v) OVER (PARTITION BY sid ORDER BY word_ix)), 9) d
        FROM pooled) WHERE d IS NOT NULL""",
    "vec_merges": _chain("vec_gaps", "sid"),
    "vec_clusters": """
    SELECT sid, s, e FROM vec_merges UNION ALL SELECT sid, word_ix, word_ix FROM pooled""",
    "vec_spans": """
    SELECT c.sid, min(x.f) s, max(x.l) e FROM vec_clusters c JOIN tok_extents x
      ON x.sid = c.sid AND x.word_ix IN (c.s, c.e) GROUP BY c.sid, c.s, c.e""",
    "features": """
    SELECT sid, s, e, list_concat(vs[s + 1], vs[e + 1]) f
    FROM vec_spans JOIN (SELECT sid, list(v ORDER BY tok_ix) vs FROM tv GROUP BY sid) USING (sid)""",
    "feature_cells": "SELECT sid, s, e, generate_subscripts(f, 1) - 1 dim, unnest(f) x FROM features",
    "hidden": """
    SELECT sid, s, e, r dim, greatest(0.0, sum(x * ((r * 31 + dim * 17 + 5) % 13 - 6) / 8.0)
           + any_value(((r * 31 + 128 * 17 + 5) % 13 - 6) / 8.0)) x
    FROM feature_cells CROSS JOIN (SELECT unnest(range(128)) r) GROUP BY sid, s, e, r""",
    "counts": """
    SELECT label, sum(CASE WHEN g THEN np ELSE 0 END)::BIGINT tp, sum(CASE WHEN g THEN 0 ELSE np END)::BIGINT fp,
           count(*) FILTER (g AND np = 0) fn
    FROM (SELECT doc_id, sent_ix, s, e, label, sum(p) np, bool_or(p = 0) g FROM (
            SELECT doc_id, sent_ix, s, e, label, 1 p FROM flat
            UNION ALL SELECT DISTINCT doc_id, sent_ix, s, e, label, 0 FROM gold_in) GROUP BY ALL)
    GROUP BY label""",
    "found": f"""
    SELECT g.label, count(*) n_gold, count(c.s) n_found
    FROM (SELECT DISTINCT {K}, s, e, label FROM gold_in) g LEFT JOIN clusters c USING ({K}, s, e)
    GROUP BY g.label""",
    "report": """
    SELECT label, sum(tp)::BIGINT tp, sum(fp)::BIGINT fp, sum(fn)::BIGINT fn,
           coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0)::DOUBLE p,
           coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0)::DOUBLE r,
           coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0)::DOUBLE f,
           coalesce(sum(n_found) / nullif(sum(n_gold), 0), 0)::DOUBLE pr
    FROM counts LEFT JOIN found USING (label) GROUP BY ROLLUP (label)""",
    "last_gold": f"SELECT {K}, s, e, arg_max(label, ord) label FROM gold_in GROUP BY ALL",
    "type_list": "SELECT * FROM (VALUES (0, 'O'), (1, 'T0'), (2, 'T1'), (3, 'T2')) t(label, name)",
}

VIEWS["assigned"] = f"SELECT {K}, s, e, label FROM scored WHERE label <> 0"
VIEWS["counts_full"] = VIEWS["counts"].replace("FROM flat", "FROM assigned")
VIEWS["report_full"] = VIEWS["report"].replace("FROM counts", "FROM counts_full")

_COHESION = """
    SELECT batch_id, round(avg((inner_far + 1) / (coalesce(near, batch_far) + 1)), 6) loss
    FROM (SELECT *, max(far) OVER (PARTITION BY batch_id) batch_far FROM (
        SELECT x.batch_id, x.sid, max({d}) far,
               coalesce(max({d}) FILTER (a.tok_ix BETWEEN x.s AND x.e AND b.tok_ix BETWEEN x.s AND x.e), 0) inner_far,
               min({d}) FILTER (a.tok_ix BETWEEN x.s AND x.e AND b.tok_ix NOT BETWEEN x.s AND x.e) near
        FROM {examples} x JOIN tv a ON a.sid = x.sid JOIN tv b ON b.sid = x.sid
        GROUP BY x.batch_id, x.sid))
    GROUP BY batch_id"""


def _potential(label: str, source: str) -> str:
    return f"""
    SELECT g.label label, count(*) n_gold, count(c.s) n_found,
           round(count(c.s) / count(*), 6) potential_recall
    FROM ({source}) g LEFT JOIN clusters c ON c.doc_id = g.doc_id AND c.sent_ix = g.sent_ix
         AND c.s = g.s AND c.e = g.e GROUP BY g.label"""


def _with_gold(candidates: str) -> str:
    return f"""
    SELECT {K}, s, e, label FROM gold_in UNION ALL SELECT {K}, s, e, 0 FROM ({candidates})"""


def _not_gold(source: str, order: str, limit: int | None) -> str:
    rows = f"SELECT * FROM {source} ANTI JOIN gold_in USING ({K}, s, e)"
    if limit is None:
        return rows
    return f"""SELECT * FROM ({rows})
    QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY {order}) <= {limit}"""


def _spans_outer(spans: str, sentences: str, label: str, cols: str) -> str:
    return f"""
    SELECT {cols}, s, e, {label} label FROM {sentences} LEFT JOIN {spans} USING ({K})"""


_SID = "doc_id || '-' || sent_ix"
_TASK_COUNTS = """
    SELECT '{task}' task, '{final}' final, {split} split, {label} label, count(*) n FROM {spans} GROUP BY ALL"""
_CHUNK_SPLIT = (
    "CASE WHEN doc_id % 10 >= 8 THEN 'test' WHEN "
    + _h60(_SID)
    + " % 100 < 20 THEN 'validation' ELSE 'train' END"
)
_CHUNK_LABEL = "CASE label WHEN 'NP' THEN 1 ELSE 2 END"
_NER_LABEL = "CAST(label[2:] AS INTEGER) + 1"

STATEMENTS: dict[str, str] = {
    "load_splits": """
    SELECT CAST(doc_id AS VARCHAR) id, text, 'train' split FROM documents
    UNION ALL SELECT conv_id || '-' || turn, text, 'validation' FROM conversations
    UNION ALL SELECT CAST(item_id AS VARCHAR), text, 'test' FROM benchmark""",
    "task_run": " UNION ALL ".join(
        [
            _TASK_COUNTS.format(task="ner", final="flat", split=_split("doc_id"), label=_NER_LABEL, spans="named_flat"),
            _TASK_COUNTS.format(task="chunk", final="flat", split=_CHUNK_SPLIT, label=_CHUNK_LABEL, spans="chunks"),
            _TASK_COUNTS.format(
                task="news_chunk", final="flat", split=_split("doc_id"), label=_CHUNK_LABEL, spans="chunks"
            ),
            f"""
    SELECT 'nested' task, 'full' final, {_split("doc_id")} split, first_seen label, count(*) n
    FROM gold JOIN first_types USING (label) GROUP BY ALL""",
            _TASK_COUNTS.format(
                task="documents", final="flat", split=_split("doc_id"), label=_NER_LABEL, spans="named_flat"
            ),
            _TASK_COUNTS.format(
                task="constituents", final="full", split=_split("doc_id"),
                label="CASE label WHEN 'S' THEN 1 WHEN 'NP' THEN 13 WHEN 'VP' THEN 21 ELSE 27 END",
                spans="(SELECT * FROM nodes WHERE label IN ('S', 'NP', 'VP', 'TOP'))",
            ),
            f"""
    SELECT 'treebank' task, 'full' final, {_split("doc_id")} split, code label, count(*) n
    FROM joined_nodes JOIN bank_labels USING (label) GROUP BY ALL""",
        ]
    ),
    "predictions_json": f"""
    SELECT {_SID} id, array_to_string(tokens, ' ') tokens, CAST(count(x) AS INTEGER) n_spans,
           md5(coalesce(string_agg(x, ';' ORDER BY x), '')) spans_md5
    FROM sentences LEFT JOIN (SELECT {K}, s || ':' || (e + 1) || ':' || name x
                              FROM scored JOIN type_list USING (label) WHERE label <> 0) USING ({K})
    GROUP BY {K}, tokens""",
    "schema_check": f"""
    SELECT {_split("doc_id")} split, reason, count(*) n FROM (
        SELECT doc_id, 'offsets' reason FROM gold JOIN sentences USING ({K})
        WHERE NOT (s < e + (doc_id % 7 = 0)::INT AND e + (doc_id % 7 = 0)::INT <= n)
        UNION ALL SELECT doc_id, 'label' FROM gold WHERE label + 2 * (doc_id % 11 = 0)::INT > 3)
    GROUP BY ALL""",
    "iob_to_spans": _spans_outer("named_flat", "sentences", "label", K),
    "iob_vocab": """
    SELECT 0 label, 'O' name UNION ALL
    SELECT CAST(row_number() OVER (ORDER BY name) AS INTEGER), name
    FROM (SELECT DISTINCT tag[3:] name FROM tagged WHERE tag LIKE 'B-%')""",
    "adapt_ner": _spans_outer("named_flat", "sentences", _NER_LABEL, f"{_SID} id, {_split('doc_id')} split"),
    "adapt_chunk": _spans_outer(
        "chunks", "sentences", "CASE label WHEN 'NP' THEN 1 WHEN 'VP' THEN 2 END",
        f"{_SID} id, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END split",
    ),
    "split_train_val": f"""
    SELECT {K}, CASE WHEN split = 'train' AND {_h60('doc_id', 'sent_ix')} % 100 < 20 THEN 'validation'
                     ELSE split END split
    FROM (SELECT {K}, {_split('doc_id')} split FROM sentences)""",
    "entity_vocab": "SELECT 0 label, 'O' name UNION ALL SELECT first_seen, name FROM first_types JOIN type_list USING (label)",
    "global_ids": f"""
    SELECT split, {K}, CAST(row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1
           ELSE 2 END, {K}) - 1 AS VARCHAR) id
    FROM (SELECT {K}, {_split('doc_id')} split FROM sentences)""",
    "encode_entities": _spans_outer(
        f"(SELECT {K}, s, e, first_seen FROM gold JOIN first_types USING (label))", "sentences", "first_seen", K
    ),
    "docs_to_sentences": f"""
    SELECT {_SID} id, CAST(doc_id AS VARCHAR) document_id, sent_ix sentence_ix, array_to_string(tokens, ' ') words
    FROM all_sentences""",
    "adapt_doc_ner": _spans_outer("named_flat", "sentences", _NER_LABEL, f"{_SID} id"),
    "tree_to_spans": """
    SELECT * FROM nodes WHERE label IN ('S', 'NP', 'VP', 'TOP')""",
    "tree_unary_collapse": f"""
    SELECT * FROM joined_nodes JOIN bank_labels USING (label)""",
    "tree_rejects": "SELECT * FROM bad_trees",
    "drop_empty": f"SELECT {K}, CAST(n AS INTEGER) n_tokens FROM sentences",
    "ignored_labels": "SELECT label, count(*) n FROM nodes WHERE label NOT IN ('S', 'NP', 'VP', 'TOP') GROUP BY label",
    "tree_single_pass": """
    SELECT CASE WHEN label IN ('S', 'NP', 'VP', 'TOP') THEN 'span' ELSE 'ignored' END what, label AS name, count(*) n
    FROM nodes GROUP BY ALL
    UNION ALL SELECT 'reject', reason, count(*) FROM bad_trees GROUP BY reason""",
    "observed_spans": f"""
    SELECT split, what, CAST(n AS BIGINT) n FROM (
        UNPIVOT (
            SELECT {_split("doc_id")} split, count(DISTINCT (doc_id, sent_ix)) "rows", count(*) FILTER (ok AND known) spans,
                   count(*) FILTER (NOT ok) offsets, count(*) FILTER (NOT known) label
            FROM (SELECT {K}, s < x AND x <= n ok, y <= 3 known
                  FROM (SELECT {K}, n, s, e + (doc_id % 7 = 0)::INT x, label + 2 * (doc_id % 11 = 0)::INT y
                        FROM sentences LEFT JOIN gold USING ({K})))
            GROUP BY ALL)
        ON "rows", spans, offsets, label INTO NAME what VALUE n)""",
    "type_names": """
    SELECT tag, type, CAST(dense_rank() OVER (ORDER BY first_tag) - 1 AS INTEGER) type_ix
    FROM (SELECT *, min(tag) OVER (PARTITION BY type) first_tag
          FROM (SELECT DISTINCT tag, CASE WHEN tag = 'O' THEN tag ELSE tag[3:] END type FROM tagged))""",
    "decode_labels": f"SELECT {K}, ord, s, e, name FROM gold_in JOIN type_list USING (label)",
    "fix_brackets": f"""
    SELECT {K}, replace(replace(array_to_string(list_transform(lv, lambda x: x[5:-2]), ' '), '-LRB-', '('),
           '-RRB-', ')') words FROM trees""",
    "positive_spans": f"SELECT {K}, s, e, label, ord FROM gold_in",
    "negative_spans": _with_gold(_not_gold("clusters", "s, e", None)),
    "limit_negatives": f"SELECT {K}, s, e FROM ({_not_gold('clusters', 's, e', 3)})",
    "undersample": f"""
    SELECT {K} FROM (SELECT *, row_number() OVER (ORDER BY md5(doc_id || ':' || sent_ix), {K}) r,
                            count(*) OVER () total FROM sentences WHERE doc_id % 10 < 8)
    WHERE r <= round_even(total * 0.3, 0)""",
    "random_spans": f"SELECT {K}, ord, s, e FROM drawn",
    "cached_candidates": f"""
    SELECT t.doc_id, t.sent_ix, p.s, p.e FROM texts t
    JOIN (SELECT txt, max((doc_id, sent_ix)) w FROM texts GROUP BY txt) l USING (txt)
    JOIN scored p ON p.doc_id = l.w[1] AND p.sent_ix = l.w[2] WHERE p.label <> 0""",
    "filter_chunk": f"""
    SELECT {K}, s, e FROM clusters c WHERE NOT EXISTS (SELECT 1 FROM named_flat g
    WHERE g.doc_id = c.doc_id AND g.sent_ix = c.sent_ix AND c.s <= g.s AND c.e >= g.e - 1)""",
    "filter_flat": f"""
    SELECT {K}, s, e FROM clusters c WHERE NOT EXISTS (SELECT 1 FROM named_flat g
    WHERE g.doc_id = c.doc_id AND g.sent_ix = c.sent_ix AND c.s >= g.s AND c.e <= g.e - 1)""",
    "default_negatives": _with_gold(_not_gold("drawn", "ord", 5)),
    "padded_batches": f"""
    SELECT batch_id, {K}, array_to_string(list_concat(types, list_transform(
           range(max(len(types)) OVER (PARTITION BY batch_id) - len(types)), lambda x: -100)), ',') types
    FROM (SELECT {K}, coalesce(types, []) types, (row_number() OVER (ORDER BY {K}) - 1) // 32 batch_id
          FROM sentences LEFT JOIN (SELECT {K}, list(label ORDER BY ord) types FROM gold GROUP BY {K})
          USING ({K}))""",
    "span_token_mask": f"""
    SELECT {K}, ord, array_to_string(list_transform(word_ids, lambda w: (w >= s AND w <= e)::INT), '') mask
    FROM gold_in JOIN sub USING ({K})""",
    "mask_to_span": f"""
    SELECT g.doc_id, g.sent_ix, g.ord, min(t.tok) tok_s, max(t.tok) tok_e
    FROM gold_in g JOIN sub_rows t ON t.doc_id = g.doc_id AND t.sent_ix = g.sent_ix
         AND t.word_id BETWEEN g.e + 1 AND 2 * g.e - g.s + 1
    GROUP BY ALL""",
    "word_extents": f'SELECT {K}, word_id, first_tok AS "first", last_tok AS "last" FROM extents',
    "insert_markers": f"""
    SELECT {K}, ord, CAST(n + 2 AS INTEGER) n_tokens, md5(array_to_string(list_concat(list_concat(tokens[1:s],
           ['[E_START]']), list_concat(list_concat(tokens[s + 1:e + 1], ['[E_END]']), tokens[e + 2:])), ' ')) marked_md5
    FROM gold_in JOIN sentences USING ({K})""",
    "phrase_hits": f"""
    SELECT DISTINCT item_id phrase_id, {K}
    FROM (SELECT item_id, list_filter(string_split(piece, ' '), lambda x: x <> '') p
          FROM (SELECT item_id, unnest(string_split(replace(text, '. ', '.' || chr(10)), chr(10))) piece
                FROM benchmark))
    JOIN (SELECT {K}, tok_ix, tokens, w FROM words JOIN sentences USING ({K})) ON w = p[1]
    WHERE len(p) > 0 AND tokens[tok_ix + 1:tok_ix + len(p)] = p""",
    "pool_words": "SELECT sid, word_ix, CAST(dim AS INTEGER) dim, round(x, 6) x FROM pooled_cells",
    "concat_layers": "SELECT sid, tok_ix, CAST(dim AS INTEGER) dim, round(x, 6) x FROM tv_cells",
    "project_vectors": "SELECT sid, tok_ix, CAST(dim AS INTEGER) dim, round(x, 6)::DOUBLE x FROM proj_cells",
    "chain_edges": f"""
    SELECT {K}, tok_ix i, tok_ix - 1 j FROM words WHERE tok_ix > 0
    UNION ALL SELECT {K}, tok_ix, CAST(tok_ix + 1 AS INTEGER) FROM words WHERE tok_ix < n - 1""",
    "pairwise_distance": " UNION ALL ".join(
        f"""
    SELECT a.sid, a.word_ix i, b.word_ix j, '{m}' metric, round({_dist('a.v', 'b.v', m)}, 9) d
    FROM pooled a JOIN pooled b ON b.sid = a.sid AND abs(a.word_ix - b.word_ix) = 1"""
        for m in ("euclidean", "cosine")
    ),
    "chain_clusters": f"SELECT {K}, s, e FROM merges",
    "cluster_set": f"SELECT {K}, s, e FROM clusters",
    "clusters_to_tokens": f"SELECT {K}, s, e, tok_s, tok_e FROM token_clusters",
    "whole_word_clusters": f"""
    SELECT {K}, s, e, tok_s, CASE WHEN (s + e) % 3 = 0 AND tok_e > tok_s THEN tok_e - 1 ELSE tok_e END tok_e
    FROM token_clusters WHERE (s + e) % 3 <> 0 OR tok_e = tok_s OR one_token""",
    "cohesion_ratio": _COHESION.format(d=_dist("a.v", "b.v", "euclidean"), examples="examples"),
    "cohesion_entities_only": f"""
    SELECT batch_id, loss FROM (SELECT DISTINCT batch_id FROM examples) LEFT JOIN (
    {_COHESION.format(d=_dist("a.v", "b.v", "cosine"), examples="(SELECT * FROM examples WHERE label <> 0)")}
    ) USING (batch_id)""",
    "source_comparison": """
    SELECT source, label, count(*) n_gold, count(hit) n_found, round(count(hit) / count(*), 6) potential_recall
    FROM (SELECT DISTINCT source, sid, s, e, label FROM examples CROSS JOIN (SELECT unnest(
          ['projected', 'all_layers', 'last_layer']) source)) LEFT JOIN src_spans USING (source, sid, s, e)
    GROUP BY GROUPING SETS ((source, label), (source))""",
    "span_features": "SELECT sid, s, e, CAST(dim AS INTEGER) dim, round(x, 6) x FROM feature_cells",
    "score_spans": """
    SELECT sid, s, e, CAST(r AS INTEGER) dim, round(sum(x * ((r * 31 + dim * 17 + 10) % 13 - 6) / 8.0)
           + any_value(((r * 31 + 128 * 17 + 10) % 13 - 6) / 8.0), 6)::DOUBLE x
    FROM hidden CROSS JOIN (SELECT unnest(range(4)) r) GROUP BY sid, s, e, r""",
    # the rule that the head has to learn
    "fit_span_classifier": f"""
    SELECT {K}, ord, s, e, CAST(CASE WHEN regexp_matches(w, '^[A-Z]') = (length(w) % 2 = 1) THEN 0
                                     ELSE 1 + length(w) % 3 END AS INTEGER) label
    FROM gold_in JOIN (SELECT {K}, tok_ix s, w FROM words) USING ({K}, s) WHERE doc_id % 10 = 9""",
    "softmax_probs": f"""
    SELECT {K}, s, e, round(p[1], 6) p0, round(p[2], 6) p1, round(p[3], 6) p2, round(p[4], 6) p3 FROM probs""",
    "assign_types": f"SELECT {K}, s, e, label, round(conf, 6) confidence FROM scored",
    "flat_select": f"""
    SELECT {K}, s, e, label, round(conf, 6) confidence FROM flat JOIN scored USING ({K}, s, e, label)""",
    "all_predictions": "SELECT * FROM predictions",
    "word_assignments": f"""
    SELECT {K}, tok_s, tok_e, s, e, label FROM token_clusters JOIN scored USING ({K}, s, e) WHERE label <> 0""",
    "cluster_membership": f"""
    SELECT {K}, ord, s, e, label, EXISTS (SELECT 1 FROM clusters c WHERE c.doc_id = g.doc_id
           AND c.sent_ix = g.sent_ix AND c.s = g.s AND c.e = g.e) is_cluster FROM gold_in g""",
    "cross_entropy": f"""
    SELECT doc_id, round(sum(loss), 4) loss, round(sum(loss * [0.25, 0.5, 2.0, 0.0][y + 1]), 4)::DOUBLE weighted
    FROM (SELECT doc_id, coalesce(label, 0) y, -ln(p[coalesce(label, 0) + 1]) loss
          FROM probs LEFT JOIN last_gold USING ({K}, s, e)) GROUP BY doc_id""",
    "span_tree": f"""
    SELECT c.doc_id, c.sent_ix, c.s, c.e, any_value(c.label) label,
           any_value(CASE WHEN c.label = 0 THEN 0.0 ELSE round(c.conf, 6) END)::DOUBLE confidence,
           arg_min(p.s, (p.e - p.s, -p.s)) parent_s, arg_min(p.e, (p.e - p.s, -p.s)) parent_e
    FROM scored c LEFT JOIN scored p ON p.doc_id = c.doc_id AND p.sent_ix = c.sent_ix
         AND p.s <= c.s AND p.e >= c.e AND p.e - p.s > c.e - c.s
    GROUP BY c.doc_id, c.sent_ix, c.s, c.e""",
    "span_confidence": f"""
    SELECT {K}, ord, g.s, g.e, coalesce(round(conf, 6), 0) confidence
    FROM gold_in g LEFT JOIN (SELECT {K}, s, e, conf FROM scored WHERE label <> 0) USING ({K}, s, e)""",
    "span_counts": "SELECT * FROM counts",
    "prf_report": """
    SELECT label, tp, fp, fn, round(p, 6) "precision", round(r, 6) recall, round(f, 6) f1,
           round(pr, 6) potential_recall FROM report""",
    "task_reports": " UNION ALL ".join(
        f"""
    SELECT label, tp, fp, fn, round(p, 6) "precision", round(r, 6) recall, round(f, 6) f1,
           round(pr, 6) potential_recall, '{task}' task FROM {view}"""
        for task, view in (("ner", "report"), ("nested", "report_full"))
    ),
    "potential_recall": """
    SELECT label, sum(n_gold)::BIGINT n_gold, sum(n_found)::BIGINT n_found,
           round(sum(n_found) / sum(n_gold), 6)::DOUBLE potential_recall FROM found GROUP BY ROLLUP (label)""",
    "potential_recall_tagged": _potential(
        "tag", f"SELECT g.doc_id, g.sent_ix, g.s, g.e, t.tag AS label FROM gold_in g JOIN tagged t "
        "ON t.doc_id = g.doc_id AND t.sent_ix = g.sent_ix AND t.tok_ix = g.s"
    ),
    "potential_recall_nested": _potential("label", "SELECT * FROM gold_in"),
    "confusion_pairs": f"""
    SELECT coalesce(g.label, 0) gold, coalesce(p.label, 0) pred, count(*) n
    FROM last_gold g FULL JOIN predictions p USING ({K}, s, e) GROUP BY ALL""",
    "confusion_cooccur": f"""
    SELECT g.label gold, p.label pred, count(*) FILTER (g.s = p.s AND g.e = p.e) n
    FROM gold_in g JOIN (SELECT * FROM scored WHERE label <> 0) p USING ({K}) GROUP BY ALL""",
    "metric_log": """
    SELECT 'metrics/val_' || CASE WHEN report.label IS NOT NULL THEN type_list.name || '_' || m
           WHEN m = 'f1' THEN m ELSE 'overall_' || m END AS name, round(CASE m WHEN 'precision' THEN p
           WHEN 'recall' THEN r WHEN 'f1' THEN f ELSE pr END, 6) AS "value"
    FROM report LEFT JOIN type_list ON type_list.label = report.label
    CROSS JOIN (SELECT unnest(['precision', 'recall', 'f1', 'potential_recall']) m)""",
    "perfect_sentences": f"""
    SELECT {K}, NOT EXISTS (SELECT 1 FROM off WHERE off.doc_id = sentences.doc_id
                            AND off.sent_ix = sentences.sent_ix) perfect FROM sentences""",
    "inference_report": """
    SELECT coalesce(name, 'overall') AS type, tp, fp, fn, round(p, 6) "precision", round(r, 6) recall,
           round(f, 6) f1, round(pr, 6) potential_recall
    FROM report LEFT JOIN type_list ON type_list.label = report.label""",
    "training_rows": _with_gold(_not_gold("last_copy", "s, e", 3)),
}

STATEMENTS["merged_report"] = STATEMENTS["stored_report"] = STATEMENTS["prf_report"]
STATEMENTS["merged_confusion"] = STATEMENTS["confusion_pairs"]

VIEWS.update(
    {
        # codes by first appearance in train
        "first_types": f"""
    SELECT label, CAST(row_number() OVER (ORDER BY seen_at) AS INTEGER) first_seen
    FROM (SELECT label, min((doc_id, sent_ix, ord)) seen_at FROM gold WHERE doc_id % 10 < 8 GROUP BY label)""",
        "off": f"""
    (SELECT DISTINCT {K}, s, e, label FROM gold_in EXCEPT SELECT {K}, s, e, label FROM flat)
    UNION ALL (SELECT {K}, s, e, label FROM flat EXCEPT SELECT {K}, s, e, label FROM gold_in)""",
        "last_copy": f"""
    SELECT t.doc_id, t.sent_ix, p.s, p.e FROM texts t
    JOIN (SELECT txt, max((doc_id, sent_ix)) w FROM texts GROUP BY txt) l USING (txt)
    JOIN clusters p ON p.doc_id = l.w[1] AND p.sent_ix = l.w[2]""",
        "src_cells": """
    SELECT 'all_layers' source, sid, word_ix, dim, x FROM tv_cells
    UNION ALL SELECT 'last_layer', sid, word_ix, dim - 48, x FROM tv_cells WHERE dim >= 48
    UNION ALL SELECT 'projected', sid, word_ix, dim, x::DOUBLE FROM proj_cells""",
        "src_words": """
    SELECT source, sid, word_ix, list(x ORDER BY dim) v
    FROM (SELECT source, sid, word_ix, dim, avg(x) x FROM src_cells GROUP BY ALL) GROUP BY ALL""",
        "src_gaps": """
    SELECT *, max(ix) OVER (PARTITION BY source, sid) + 1 n_gaps FROM (
        SELECT source, sid, word_ix ix,
               round(list_distance(v, lead(v) OVER (PARTITION BY source, sid ORDER BY word_ix)), 9) d
        FROM src_words) WHERE d IS NOT NULL""",
        "src_merges": _chain("src_gaps", "source, sid"),
        "src_spans": """
    SELECT c.source, c.sid, min(x.f) s, max(x.l) e, 1 hit
    FROM (SELECT source, sid, s, e FROM src_merges UNION ALL SELECT source, sid, word_ix, word_ix FROM src_words) c
    JOIN tok_extents x ON x.sid = c.sid AND x.word_ix IN (c.s, c.e) GROUP BY c.source, c.sid, c.s, c.e""",
    }
)


def _used(text: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b(?!\()", text)]


def statement(name: str) -> str:
    """The query's SQL with the views it needs, dependencies first."""
    body = STATEMENTS[name]
    ordered: list[str] = []

    def need(text: str, path: tuple[str, ...]) -> None:
        for view in _used(text):
            if view not in ordered and view not in path:
                need(VIEWS[view], (*path, view))
                ordered.append(view)

    need(body, ())
    if not ordered:
        return body
    views = ",\n".join(f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in ordered)
    return f"WITH {views}\n{body}"


def all_sql() -> dict[str, str]:
    return {name: statement(name) for name in STATEMENTS}
