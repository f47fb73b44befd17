"""ANSI SQL for the registered queries, written from their definitions and run by another engine."""

from __future__ import annotations

from nearkin.functions import text as T
from nearkin.functions.wordlists import ENGLISH_STOP_WORDS, LEMMA_RULES, POS_ENDINGS
from nearkin.operators.tables import TICKET_SCHEMA
from nearkin.plans.queries import MIN_SHARE, N_BEST, NEAR


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


STOP = "(" + ", ".join(lit(w) for w in ENGLISH_STOP_WORDS) + ")"


def replaced(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(by)}, 'g')"


def found(expr: str, pattern: str) -> str:
    # This engine never backtracks and has no possessive repeats.
    return f"regexp_extract_all({expr}, {lit(pattern.replace(')*+', ')*'))})"


# Tokens

ALPHA = found("lower(text)", T.ALPHA_TOKEN)
WORD = found("lower(text)", T.WORD_TOKEN)
PUNCT = found(
    replaced(replaced("lower(text)", T.CONTRACTED_NOT, r"\1 n't"), T.CONTRACTED_VERB, r" '\1\2"), T.PUNCT_TOKEN
)
STANDARD = f"string_split_regex({replaced('lower(text)', r'\s+\z', '')}, '\\s')"


def once(sql: str) -> str:
    """``sql`` with each of its CTEs evaluated once."""
    return sql.replace(" AS (\n", " AS MATERIALIZED (\n")


def token_list(expr: str) -> str:
    return f"SELECT doc_id, len(t)::BIGINT AS n, coalesce(array_to_string(t, ' '), '') AS tokens FROM (SELECT doc_id, {expr} AS t FROM documents)"


def counts(name: str, source: str, id_col: str, alias: str = "doc_id") -> str:
    """A CTE of term counts under the plain word analyzer."""
    return f"""{name} AS (
      SELECT doc_id AS {alias}, term, count(*)::BIGINT AS tf
      FROM (SELECT {id_col} AS doc_id, unnest({WORD}) AS term FROM {source})
      WHERE term NOT IN {STOP} GROUP BY ALL)"""


def vectors(name: str, source: str, id_col: str = "doc_id") -> str:
    return f"""{name} AS (
      SELECT {id_col}, term, tf, df, r / sqrt(sum(r * r) OVER (PARTITION BY {id_col})) AS w
      FROM (SELECT {id_col}, term, tf, df, tf * idf AS r FROM {source} JOIN voc USING (term)))"""


CORPUS = ",\n".join(
    [
        "WITH " + counts("cnt", "documents", "doc_id"),
        """voc AS (
      SELECT term, count(*)::BIGINT AS df,
             ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf
      FROM cnt GROUP BY term)""",
        vectors("vec", "cnt"),
    ]
)


def scored(source: str = "benchmark", id_col: str = "item_id") -> str:
    """The corpus, its query vectors and all non-zero scores."""
    return ",\n".join(
        [
            CORPUS,
            counts("qcnt", source, id_col, "query_id"),
            vectors("qvec", "qcnt", "query_id"),
            """dot AS (
      SELECT query_id, doc_id, round(sum(v.w * q.w), 6) AS score
      FROM vec v JOIN qvec q USING (term) GROUP BY ALL)""",
        ]
    )


def ranked(n: int = N_BEST) -> str:
    return f"""{scored()}, best AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM dot)
      WHERE rank <= {n})"""


# Analyzers with lemmas

POS = (
    "CASE "
    + " ".join(
        "WHEN " + " OR ".join(f"ends_with(token, {lit(e)})" for e in endings) + f" THEN {lit(pos)}"
        for pos, endings in POS_ENDINGS
    )
    + " ELSE 'N' END"
)
RULES = ", ".join(
    f"({lit(pos)}, {lit(suffix)}, {lit(base)})" for pos, rules in LEMMA_RULES.items() for suffix, base in rules
)


def lemmas(tokens: str, custom: bool, source: str = "documents", id_col: str = "doc_id") -> str:
    """CTEs: token counts, tagged distinct tokens and their lemmas; the lexicon is that of the documents."""
    pos = f"CASE WHEN token IN (SELECT token FROM lex) THEN {POS} ELSE 'N' END" if custom else "'N'"
    return f"""WITH tok AS (
      SELECT doc_id, token, count(*)::BIGINT AS n
      FROM (SELECT {id_col} AS doc_id, unnest({tokens}) AS token FROM {source}) GROUP BY ALL),
    lex AS (SELECT DISTINCT token FROM (SELECT unnest({tokens}) AS token FROM documents)),
    words AS (SELECT * FROM (SELECT token, {pos} AS pos FROM (SELECT DISTINCT token FROM tok)) WHERE pos IN ('N', 'V')),
    rules(pos, suffix, base) AS (VALUES {RULES}),
    forms AS (
      SELECT token, pos, token AS form FROM words
      UNION
      SELECT token, pos, left(token, length(token) - length(suffix)) || base
      FROM words JOIN rules USING (pos) WHERE ends_with(token, suffix) AND length(token) > length(suffix)),
    lem AS (
      SELECT token, pos, coalesce(form, token) AS lemma FROM words LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY token, pos ORDER BY length(form), form) AS r
        FROM forms WHERE form IN (SELECT token FROM lex)) f USING (token, pos) WHERE coalesce(r, 1) = 1)"""


def analyzed(tokens: str, custom: bool, source: str = "documents", id_col: str = "doc_id", alias: str = "doc_id") -> str:
    return f"""{lemmas(tokens, custom, source, id_col)}
    SELECT doc_id AS {alias}, lemma AS term, sum(n)::BIGINT AS tf FROM tok JOIN lem USING (token)
    WHERE length(lemma) >= 3 AND lemma NOT IN {STOP} GROUP BY ALL"""


def predicted_lemmas(tokens: str, custom: bool) -> str:
    """The best documents of each benchmark text under an analyzer with lemmas."""
    return f"""WITH cnt AS MATERIALIZED ({analyzed(tokens, custom)}),
    voc AS MATERIALIZED (
      SELECT term, count(*)::BIGINT AS df, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf
      FROM cnt GROUP BY term),
    {vectors("vec", "cnt")},
    qcnt AS MATERIALIZED ({analyzed(tokens, custom, "benchmark", "item_id", "query_id")}),
    {vectors("qvec", "qcnt", "query_id")},
    dot AS (
      SELECT query_id, doc_id, round(sum(v.w * q.w), 6) AS score FROM vec v JOIN qvec q USING (term) GROUP BY ALL),
    best AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM dot)
      WHERE rank <= {N_BEST})
    SELECT query_id, rank, doc_id, score, source, lang FROM best JOIN documents USING (doc_id)"""


# Tickets made of documents and pages

ISSUES = """WITH issues AS (
      SELECT doc_id, source AS repo, 'https://tracker.example.org/' || source || '/issues/' || doc_id AS url,
        string_split(text, chr(10))[1] AS title,
        '## Describe the issue' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Reported in *' || lang || '* for _'
        || source || '_ and ~nothing~ else.' || chr(10)
        || coalesce(chr(10) || 'See [the page](' || p.url || ') or ' || p.url || ' .' || chr(10) || chr(10) || '```' || chr(10)
          || html || chr(10) || '```' || chr(10) || 'Use `page_id` here.' || chr(10), '') AS body
      FROM documents LEFT JOIN pages p ON doc_id = page_id)"""


def no_code(c: str) -> str:
    return replaced(replaced(c, T.FENCED_CODE, " "), T.INLINE_CODE, r"\1")


def no_urls(c: str) -> str:
    return replaced(replaced(c, T.EMBEDDED_LINK, r"\1"), T.BARE_URL, r"\1")


def no_marks(c: str) -> str:
    for pattern, group in T.EMPHASIS:
        c = replaced(c, pattern, rf"\{group}")
    for _ in range(2):
        c = replaced(c, T.UNDERSCORES, r"\1\2\3")
    return c


def without_template(source: str) -> str:
    """CTEs that drop headings and repeated lines from ``source(doc_id, repo, url, title, body)``."""
    return f"""lines AS (
      SELECT repo, line, count(*) AS n
      FROM (SELECT repo, unnest(list_distinct(string_split(body, chr(10)))) AS line FROM {source})
      WHERE trim(line) <> '' GROUP BY ALL),
    totals AS (SELECT repo, count(*) AS texts FROM {source} GROUP BY repo),
    repeated AS (
      SELECT repo, list(line) AS lines FROM lines JOIN totals USING (repo)
      WHERE n >= 2 AND n >= texts * {MIN_SHARE} GROUP BY repo),
    kept AS (
      SELECT doc_id, url, title, coalesce(array_to_string(list_filter(string_split(body, chr(10)),
          lambda x: NOT regexp_matches(x, {lit(T.HEADING)}) AND NOT list_contains(coalesce(lines, []), x)), chr(10)), '') AS body
      FROM {source} LEFT JOIN repeated USING (repo))"""


# Standard tokens for the flow

FLOW = f"""WITH cnt AS (
      SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({STANDARD}) AS term FROM documents) GROUP BY ALL),
    freq AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM cnt GROUP BY term),
    kept AS (
      SELECT term, df FROM freq WHERE df <= floor((SELECT count(*) FROM documents) * 0.999)
      ORDER BY cf DESC, term LIMIT 262144),
    flow AS (
      SELECT doc_id, term, tf, CASE WHEN df >= 5
        THEN tf * ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) ELSE 0 END AS w
      FROM cnt JOIN kept USING (term))"""

# Dense vectors

COORDS = """WITH x AS (
      SELECT vec_id AS doc_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    q AS (SELECT label::BIGINT AS query_id, pos, round(avg(x), 6) AS y FROM x GROUP BY ALL)"""
BEST_DENSE = f"""SELECT * FROM (
      SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s)
    WHERE rank <= {N_BEST}"""

MD5_HASH = "('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT"
SPLIT = f"CASE WHEN {MD5_HASH} % 100 < 80 THEN 'train' ELSE 'validation' END AS split"
PARTIES = """SELECT c_custkey AS key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier"""
PREDICTED = f"{ranked()} SELECT query_id, rank, doc_id, score, source, lang FROM best JOIN documents USING (doc_id)"

TICKETS = """WITH tickets AS (SELECT o_orderkey::VARCHAR AS id, 'order-' || o_custkey AS title, o_custkey::VARCHAR AS "databaseId",
      CASE WHEN o_orderkey % 7 = 0 THEN '#' || o_orderkey ELSE o_orderkey::VARCHAR END AS number,
      CASE o_orderstatus WHEN 'P' THEN 'partly' WHEN 'F' THEN 'true' ELSE 'false' END AS closed
    FROM orders)"""
PRESENT = {
    "id": "id", "title": "title", "databaseId": '"databaseId"::BIGINT', "number": "TRY_CAST(number AS BIGINT)",
    "closed": "CASE closed WHEN 'true' THEN true WHEN 'false' THEN false END",
}
TICKET_COLUMNS = ", ".join(f'{PRESENT.get(c, "NULL")}::{t.replace("string", "varchar")} AS "{c}"' for c, t in TICKET_SCHEMA.items())

ORACLE: dict[str, str] = {
    # Sources and sinks
    "scan_dir": PARTIES,
    "scan_prefix": "SELECT * FROM orders",
    "scan_many": "SELECT * FROM orders",
    "scan_csv": "SELECT * FROM pages",
    "get_or_build": f"{CORPUS} SELECT term, df FROM voc",
    "scan_sampled": "SELECT event_id, user_id, event_type, value, props FROM events ORDER BY event_id LIMIT 50000",
    "write_csv": "SELECT * FROM documents",
    "export": "SELECT vec_id, label, len(embedding)::BIGINT AS length, true AS same FROM embeddings",
    "preview_chunks": "SELECT * FROM documents ORDER BY doc_id LIMIT 1000",
    "save_model": f"{CORPUS} SELECT doc_id, term, tf, round(w, 6) AS w FROM vec",
    "load_model": PREDICTED,
    "write_labelled_csv": "SELECT p_retailprice, p_partkey, p_size FROM part",
    "write_split": f"SELECT o_orderkey, o_orderstatus, o_totalprice, {SPLIT} FROM orders",
    # Projections, filters, casts, unions
    "corpus_labels": f"{ISSUES} SELECT body AS corpus, url, title FROM issues",
    "query_eq": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'",
    "infer_and_cast": "SELECT * REPLACE (l_linenumber::BIGINT AS l_linenumber) FROM lineitem",
    "conform": f"{TICKETS} SELECT {TICKET_COLUMNS} FROM tickets",
    "cast_rejects": f"""{TICKETS}
      SELECT id, 'number' AS "column", 'bigint' AS "type", number AS "value" FROM tickets WHERE number LIKE '#%'
      UNION ALL SELECT id, 'closed', 'boolean', closed FROM tickets WHERE closed NOT IN ('true', 'false')""",
    "drop_cols": "SELECT c_custkey, c_nationkey, c_acctbal FROM customer",
    "label_first": "SELECT p_retailprice, p_partkey, p_name, p_brand, p_type, p_size FROM part",
    "title_body": f"{ISSUES} SELECT doc_id, title || chr(10) || chr(10) || body AS title_body FROM issues",
    "scale_const": "SELECT o_orderkey, o_totalprice / 100000.0::DOUBLE AS o_totalprice FROM orders",
    "concat_rows": PARTIES,
    "concat_dedupe": "SELECT text FROM documents UNION SELECT text FROM conversations UNION SELECT text FROM benchmark",
    "distinct_values": "SELECT DISTINCT source FROM documents",
    "vocab_size": f"{CORPUS} SELECT count(*)::BIGINT AS terms FROM voc",
    # Cleaning
    "strip_code": f"{ISSUES} SELECT doc_id, {no_code('body')} AS body FROM issues",
    "strip_urls": f"{ISSUES} SELECT doc_id, {no_urls('body')} AS body FROM issues",
    "strip_markdown": f"{ISSUES} SELECT doc_id, {no_marks('body')} AS body FROM issues",
    "drop_boilerplate": f"{ISSUES}, {without_template('issues')} SELECT doc_id, body FROM kept",
    "concat_comments": """SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text, count(*)::BIGINT AS parts
      FROM conversations GROUP BY conv_id""",
    "clean_issue": f"""{ISSUES}, bare AS (SELECT doc_id, repo, url, title, {no_marks(no_urls(no_code('body')))} AS body FROM issues),
      {without_template('bare')} SELECT title || chr(10) || chr(10) || body AS title_body, url, title FROM kept""",
    # Tokens
    "tokens_alpha": token_list(ALPHA),
    "tokens_word": token_list(WORD),
    "tokens_punct": token_list(PUNCT),
    "tokens_standard": token_list(STANDARD),
    "stop_words": token_list(f"list_filter({WORD}, lambda x: x NOT IN {STOP})"),
    "min_len": token_list(f"list_filter({WORD}, lambda x: length(x) >= 3)"),
    "pos_filter": f"""{lemmas(ALPHA, True)} SELECT doc_id, token, n, pos FROM tok JOIN words USING (token)""",
    "lemma": f"{lemmas(ALPHA, True)} SELECT token, pos, lemma FROM lem",
    "analyzer_default": analyzed(PUNCT, False),
    "analyzer_custom": analyzed(ALPHA, True),
    "analyzer_none": f"{CORPUS} SELECT doc_id, term, tf FROM cnt",
    "common_words": f"""{ranked(1)} SELECT query_id, doc_id, coalesce(string_agg(term, ' ' ORDER BY term), '') AS words
      FROM best LEFT JOIN (SELECT query_id, doc_id, term FROM qcnt JOIN cnt USING (term)) USING (query_id, doc_id)
      GROUP BY query_id, doc_id""",
    # Weights
    "term_counts": f"{CORPUS} SELECT doc_id, term, tf FROM cnt",
    "doc_freq": f"{CORPUS} SELECT term, df FROM voc",
    "idf": f"{CORPUS} SELECT term, df, round(idf, 6) AS idf FROM voc",
    "tfidf_l2": f"{CORPUS} SELECT doc_id, term, tf, round(w, 6) AS w FROM vec",
    "transform": f"{scored()} SELECT query_id, term, tf, round(w, 6) AS w FROM qvec",
    "count_vectorize": f"{FLOW} SELECT doc_id, term, tf::DOUBLE AS tf FROM flow",
    "idf_min_df": f"{FLOW} SELECT doc_id, term, tf::DOUBLE AS tf, round(w, 6) AS w FROM flow",
    "vector_col": f"""{FLOW} SELECT term, (count(*) FILTER (w <> 0))::BIGINT AS docs, round(sum(w), 4) AS total
      FROM flow GROUP BY term""",
    "fit": f"""WITH a AS ({analyzed(ALPHA, True)})
      SELECT term, count(*)::BIGINT AS df, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1, 6) AS idf
      FROM a GROUP BY term""",
    # Search
    "dot_sparse": f"{scored()} SELECT query_id, doc_id, score FROM dot",
    "dot_dense": f"""{COORDS}, s AS (
        SELECT query_id, doc_id, round(sum(x * y), 6) AS score FROM x JOIN q USING (pos) GROUP BY ALL) {BEST_DENSE}""",
    "dense_labels": f"""{COORDS}, s AS (
        SELECT query_id, doc_id, round(sum(x * y), 6) AS score FROM x JOIN q USING (pos) GROUP BY ALL),
      b AS ({BEST_DENSE})
      SELECT b.*, label FROM b JOIN embeddings ON vec_id = doc_id""",
    "cosine_nan": f"""{COORDS}, s AS (
        SELECT query_id, doc_id, round(coalesce(
          sum(CASE WHEN kept THEN x * y END) / nullif(sqrt(sum(CASE WHEN kept THEN x * x END)) * sqrt(sum(CASE WHEN kept THEN y * y END)), 0),
          1.0), 6) AS score
        FROM (SELECT *, abs(x) >= 0.02 AND abs(y) >= 0.005 AS kept FROM x JOIN q USING (pos)) GROUP BY query_id, doc_id)
      {BEST_DENSE}""",
    "top_n": f"{ranked()} SELECT query_id, doc_id, score, rank FROM best",
    "label_lookup": f"{ranked()} SELECT query_id, rank, doc_id, quality, toxic FROM best LEFT JOIN labels USING (doc_id)",
    "pad_zero": f"""WITH names AS (SELECT p_name AS text, min(p_partkey) AS query_id FROM part GROUP BY p_name),
      {scored('names', 'query_id')[5:]},
      low AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT {N_BEST}),
      alls AS (
        SELECT query_id, doc_id, score, 0 AS filler FROM dot
        UNION ALL
        SELECT n.query_id, l.doc_id, 0.0::DOUBLE, 1 FROM names n, low l
        WHERE NOT EXISTS (SELECT 1 FROM dot d WHERE d.query_id = n.query_id AND d.doc_id = l.doc_id))
      SELECT query_id, rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY filler, score DESC, doc_id)::INT AS rank FROM alls)
      WHERE rank <= {N_BEST}""",
    "predict": PREDICTED,
    "predict_custom": predicted_lemmas(ALPHA, True),
    "predict_default": predicted_lemmas(PUNCT, False),
    "predict_obj": f"""{ranked()} SELECT query_id, b.text, rank - 1 AS pos, source, lang, score
      FROM best JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id""",
    "inspect_doc": f"""{CORPUS} SELECT * FROM (
        SELECT doc_id, term, round(w, 6) AS weight,
          row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 6) DESC, term)::INT AS rank FROM vec) WHERE rank <= 10""",
    "get_weights": f"""{once(ranked(1))}, words AS MATERIALIZED (
        SELECT query_id, doc_id, unnest(t) AS term, unnest(range(len(t)))::INT AS pos
        FROM (SELECT query_id, doc_id, {found('text', T.WORD_TOKEN)} AS t FROM best JOIN benchmark ON item_id = query_id))
      SELECT w.query_id, w.doc_id, w.pos, w.term,
        round(CASE WHEN v.term IS NULL THEN NULL ELSE coalesce(h.w, 0.0) END, 6) AS weight
      FROM words w LEFT JOIN voc v ON v.term = w.term LEFT JOIN vec h ON h.term = w.term AND h.doc_id = w.doc_id""",
    "near_dups": f"""{CORPUS}, pairs AS (
        SELECT b.doc_id, a.doc_id AS first_id, round(sum(a.w * b.w), 6) AS score
        FROM vec a JOIN vec b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL)
      SELECT doc_id, min(first_id) AS first_id, arg_min(score, first_id) AS score
      FROM pairs WHERE score >= {NEAR} GROUP BY doc_id""",
    "batch_vs_catalog": f"""{scored()}, alls AS (
        SELECT query_id, 'catalog' AS side, doc_id, score FROM dot
        UNION ALL
        SELECT q.query_id, 'batch', o.query_id, round(sum(q.w * o.w), 6)
        FROM qvec q JOIN qvec o ON q.term = o.term AND q.query_id <> o.query_id GROUP BY q.query_id, o.query_id)
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, side DESC, doc_id)::INT AS rank FROM alls)
      WHERE rank <= {N_BEST}""",
    "score_gap": f"""{ranked()}, gap AS (
        SELECT query_id, max(score) FILTER (rank = 1) AS best, max(score) FILTER (rank = 2) AS next,
          avg(score) FILTER (rank >= 2) AS rest FROM best GROUP BY query_id)
      SELECT query_id, best, next, round(rest, 6) AS rest_avg, round(best / next, 6) AS ratio_next,
        round(best / rest, 6) AS ratio_rest FROM gap""",
    "cross_group_match": f"""{ranked(1)}, own AS (
        SELECT query_id, source AS own FROM best JOIN documents USING (doc_id))
      SELECT * FROM (
        SELECT query_id, doc_id, score, source AS grp, own,
          row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank
        FROM dot JOIN documents USING (doc_id) JOIN own USING (query_id) WHERE source <> own) WHERE rank <= {N_BEST}""",
    # Feature tables
    "split_positional": """SELECT o_orderkey, o_totalprice, CASE WHEN row_number() OVER (ORDER BY o_orderkey)
      <= floor(0.8 * (SELECT count(*) FROM orders)) THEN 'train' ELSE 'test' END AS split FROM orders""",
    "split_random": f"SELECT o_orderkey, o_custkey, {SPLIT} FROM orders",
    "standardize": """WITH s AS (
        SELECT *, CASE WHEN row_number() OVER (ORDER BY p_partkey) <= floor(0.8 * (SELECT count(*) FROM part))
          THEN 'train' ELSE 'test' END AS split FROM part),
      m AS (SELECT avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(p_retailprice) AS mp, stddev_pop(p_retailprice) AS sp
        FROM s WHERE split = 'train')
      SELECT p_partkey, split, round((p_size - ms) / ss, 6) AS p_size, round((p_retailprice - mp) / sp, 6) AS p_retailprice
      FROM s, m""",
    "kfold": f"""SELECT ({MD5_HASH} % 5)::INT AS fold, count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS avg_price
      FROM orders GROUP BY ALL""",
    "error_gate": """SELECT count(*)::BIGINT AS total, sum((quality <> 1 - toxic)::INT)::BIGINT AS wrong,
        round(sum((quality <> 1 - toxic)::INT) / count(*), 6) AS error,
        sum((quality <> 1 - toxic)::INT) / count(*) < 0.1 AS passed FROM labels""",
    # Streams
    "parse_requests": """SELECT 'benchmark' AS kind, item_id AS id, text, true AS ok FROM benchmark
      UNION ALL SELECT 'events', event_id, NULL, false FROM events
      UNION ALL SELECT 'documents', doc_id, NULL, false FROM documents""",
    "stream_score": PREDICTED,
    "catalog_search": PREDICTED,
    "catalog_append": f"{CORPUS} SELECT term, df, round(idf, 6) AS idf FROM voc",
    "feedback_counts": """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS votes,
        round(sum(value), 2) AS total
      FROM events GROUP BY ALL""",
    "feedback_late": """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS votes,
        round(sum(value), 2) AS total
      FROM events GROUP BY ALL""",
}
