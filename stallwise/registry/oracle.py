"""SQL (DuckDB) for the named queries, written from the meaning of each operator.

``CTES`` states the derived tables; ``sql`` puts the ones a query needs in front.
"""

from __future__ import annotations

import re

NOW = "TIMESTAMP '2024-02-20 00:00:00'"
RETENTION_NOW = "TIMESTAMP '2024-02-02 00:00:00'"
SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"
ISO = "'%Y-%m-%d %H:%M:%S'"
ANY_NUMBER = r"[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))"
EDGES = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
SHARES = [0.006848, 0.027733, 0.079139, 0.159183, 0.225747]
CATEGORICAL = ["main_category", "sub_category", "brand", "price_bucket", "rating_bucket"]
NUMERIC = ["actual_price_clean", "rating_clean", "rating_count_log", "about_product_length",
           "review_content_length", "price_log", "category_popularity", "brand_popularity",
           "high_engagement", "price_rating_interaction", "engagement_score"]
INPUTS = CATEGORICAL + NUMERIC


def number(text: str) -> str:
    return f"CASE WHEN regexp_full_match({text}, '{ANY_NUMBER}') THEN TRY_CAST({text} AS DOUBLE) END"


def stripped(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def bucket(value: str, edges: list, names: list, closed: str) -> str:
    op = "<=" if closed == "right" else "<"
    whens = " ".join(f"WHEN {value} {op} {e} THEN '{n}'" for e, n in zip(edges, names))
    low = f"WHEN {value} IS NULL OR {value} <= 0 THEN 'nan'" if closed == "right" else ""
    rest = names[-1] if len(names) > len(edges) else "nan"
    return f"CASE {low} {whens} ELSE '{rest}' END"


PRICE_NAMES = ["very_low", "low", "medium", "high", "premium"]
RATING_NAMES = ["poor", "average", "good", "very_good", "excellent"]


def price_bucket(value: str, closed: str = "right") -> str:
    return bucket(value, [500, 2000, 10000, 50000], PRICE_NAMES, closed)


def rating_bucket(value: str, closed: str = "right") -> str:
    edges = [2.5, 3.5, 4.0, 4.5] + ([5.0] if closed == "right" else [])
    return bucket(value, edges, RATING_NAMES, closed)


def first_number(text: str) -> str:
    return rf"coalesce(TRY_CAST(regexp_extract(replace({text}, ',', ''), '[\d.]+') AS DOUBLE), 0.0)"


PRICE = "coalesce(" + number(r"regexp_replace({0}, '[₹$,\s]', '', 'g')") + ", 0.0)"
DISCOUNT = "coalesce(" + number(r"regexp_replace(discount_percentage, '[%\s]', '', 'g')") + ", 0.0)"
RATING = "coalesce(" + number("trim(rating)") + ", 0.0)"
COUNT = "coalesce(CAST(trunc(" + number(r"regexp_replace(rating_count, '[,\s]', '', 'g')") + ") AS BIGINT), 0)"


def price_of(column: str) -> str:
    return PRICE.replace("{0}", column)


def level(i: int) -> str:
    return f"coalesce(trim(str_split(category, '|')[{i}]), 'Unknown')"


WORDS = r"regexp_split_to_array(trim(product_name), '\s+')"
FIRST = f"regexp_replace({WORDS}[1], '[®™©]', '', 'g')"
BRAND = f"""CASE
  WHEN product_name IS NULL OR trim(product_name) = '' THEN 'Unknown'
  WHEN lower({FIRST}) = 'amazon' AND lower({WORDS}[2]) = 'basics' THEN 'AmazonBasics'
  WHEN lower({FIRST}) = 'fire' AND lower({WORDS}[2]) = 'boltt' THEN 'Fire-Boltt'
  ELSE CASE lower({FIRST}) WHEN 'mi' THEN 'MI' WHEN 'hp' THEN 'HP' WHEN 'lg' THEN 'LG'
    WHEN 'jbl' THEN 'JBL' WHEN 'ptron' THEN 'pTron' WHEN 'boat' THEN 'boAt' WHEN 'iqoo' THEN 'iQOO'
    WHEN '' THEN 'Unknown' ELSE {FIRST} END END"""

INTENT = """CASE
  WHEN regexp_matches(lower({q}), 'price|cost|cheap|expensive|budget') THEN 'price'
  WHEN regexp_matches(lower({q}), 'best|recommend|suggest|top') THEN 'recommend'
  WHEN regexp_matches(lower({q}), 'discount|offer|deal|sale') THEN 'discount'
  WHEN regexp_matches(lower({q}), 'rating|review|popular') THEN 'rating'
  ELSE 'general' END"""

LINE = """(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END) || ': ' ||
  (CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END)"""

COSINE = """list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) /
  ((sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) + 1e-10) *
   (sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))) + 1e-10))"""


def cosine(a: str, b: str) -> str:
    return f"round({COSINE.format(a=a, b=b)}, 12)"


CTES = {
    "lines": """SELECT l_partkey, count(*) AS n,
        CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS d,
        CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY l_partkey""",
    "parts": """SELECT p.p_partkey AS k, p.*, l.q, l.d * 10 // l.n AS pct,
        CASE p_partkey % 3
          WHEN 0 THEN CAST(floor(p_retailprice * p_size) AS BIGINT) // 10
          WHEN 1 THEN CAST(floor(p_retailprice * p_size) AS BIGINT)
          ELSE CAST(floor(p_retailprice * p_size) AS BIGINT) * 3 END AS price,
        CASE p_partkey % 13 WHEN 1 THEN 'boat' WHEN 2 THEN 'Amazon Basics' WHEN 3 THEN 'Fire Boltt'
          WHEN 4 THEN 'mi™' WHEN 5 THEN 'JBL®' WHEN 6 THEN 'ptron' ELSE p_brand END AS word,
        CASE WHEN p_partkey % 6 = 0 THEN ' | ' ELSE '|' END AS bar,
        (p_size // 10) || '.' || (p_size % 10) AS stars
        FROM part p LEFT JOIN lines l ON l.l_partkey = p.p_partkey""",
    "docs": "SELECT doc_id, text, count(*) OVER () AS n_docs FROM documents",
    "raw": """SELECT
        CASE WHEN k % 101 <> 0 THEN 'P' || lpad(CAST(k AS VARCHAR), 8, '0') END AS product_id,
        CASE WHEN k % 211 = 0 THEN NULL WHEN k % 3 = 0 THEN word || ' ' || p_name
          ELSE word || ' ' || p_name || ' ' || p_size END AS product_name,
        CASE WHEN k % 83 = 0 THEN NULL WHEN k % 19 = 0 THEN p_type || '|'
          ELSE p_type || bar || split_part(p_name, ' ', 2) ||
            CASE WHEN k % 4 = 0 THEN bar || split_part(p_name, ' ', 1) ELSE '' END END AS category,
        '₹' || format('{:,}', price * (100 - pct) // 100) AS discounted_price,
        CASE WHEN k % 97 = 0 THEN '|' WHEN k % 31 = 0 THEN '$' || price
          ELSE '₹' || format('{:,}', price) END AS actual_price,
        CASE WHEN k % 103 = 0 THEN '120%' WHEN k % 89 = 0 THEN NULL ELSE pct || '%' END AS discount_percentage,
        CASE WHEN k % 79 = 0 THEN 'N/A' WHEN k % 73 = 0 THEN NULL
          WHEN k % 9 = 0 THEN ' ' || stars || ' ' ELSE stars END AS rating,
        CASE WHEN k % 71 = 0 THEN NULL WHEN k % 67 = 0 THEN format('{:,}', q * 10) || '.7'
          ELSE format('{:,}', q * 10) END AS rating_count,
        a.text AS about_product, r.text AS review_content, k AS ord
        FROM parts
        LEFT JOIN docs a ON k % 11 <> 0 AND a.doc_id = k % (SELECT count(*) FROM documents)
        LEFT JOIN docs r ON k % 17 <> 0 AND r.doc_id = (k * 7 + 3) % (SELECT count(*) FROM documents)""",
    "named": """SELECT * FROM raw
        QUALIFY row_number() OVER (PARTITION BY product_name ORDER BY ord) = 1""",
    "columns": f"""SELECT * EXCLUDE (discount_percentage),
        {price_of('actual_price')} AS actual_price_clean,
        {price_of('discounted_price')} AS discounted_price_clean,
        {DISCOUNT} AS discount_percentage, {RATING} AS rating_clean, {COUNT} AS rating_count_clean,
        {level(1)} AS main_category, {level(2)} AS sub_category, {level(3)} AS sub_sub_category,
        {BRAND} AS brand,
        length(coalesce(about_product, '')) AS about_product_length,
        length(coalesce(review_content, '')) AS review_content_length FROM named""",
    "clean": """SELECT * FROM columns WHERE product_id IS NOT NULL AND actual_price_clean > 0
        AND discount_percentage BETWEEN 0 AND 100""",
    "feat": f"""SELECT *, ln(1 + actual_price_clean) AS price_log, ln(1 + rating_count_clean) AS rating_count_log,
        {price_bucket('actual_price_clean')} AS price_bucket, {rating_bucket('rating_clean')} AS rating_bucket,
        CAST(rating_count_clean > (SELECT median(rating_count_clean) FROM clean) AS INTEGER) AS high_engagement,
        count(*) OVER (PARTITION BY main_category) AS category_popularity,
        count(*) OVER (PARTITION BY brand) AS brand_popularity,
        ln(1 + actual_price_clean) * rating_clean AS price_rating_interaction,
        rating_clean * ln(1 + rating_count_clean) AS engagement_score FROM clean""",
    "coded": "SELECT product_id, ord, " + ", ".join(
        f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS BIGINT) AS {c}" for c in CATEGORICAL) + ", "
        + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC) + " FROM feat",
    "texts": "SELECT *, " + stripped(
        "'Product: ' || coalesce(product_name, 'nan') || chr(10) || 'Product ID: ' || product_id || chr(10) || "
        "'Brand: ' || brand || chr(10) || 'Category: ' || main_category || ' > ' || sub_category || chr(10) || "
        "'Original Price: ' || coalesce(actual_price, 'nan') || chr(10) || "
        "'Sale Price: ' || coalesce(discounted_price, 'nan') || chr(10) || "
        "'Discount: ' || CAST(round_even(discount_percentage, 0) AS BIGINT) || '% off' || chr(10) || "
        "'Rating: ' || CAST(rating_clean AS VARCHAR) || '/5 (' || format('{:,}', rating_count_clean) || ' reviews)' "
        "|| chr(10) || 'Description: ' || coalesce(substr(about_product, 1, 500), 'N/A') || chr(10) || "
        "'Review: ' || coalesce(substr(review_content, 1, 300), 'N/A')") + " AS rag_document FROM clean",
    "msgs": """SELECT conv_id * 1000 + turn AS id, 'user_' || conv_id AS session_id, role, text AS content,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 60 + turn) AS ts FROM conversations""",
    "sess": """SELECT session_id, min(ts) AS created_at, max(ts) AS last_activity, count(*) AS message_count
        FROM msgs GROUP BY session_id""",
    "asks": """SELECT id AS query_id, session_id, ts, CAST(id % 23 AS INTEGER) AS top_k,
        content || CASE (id // 1000 + id % 1000) % 6 WHEN 0 THEN ' what is the price'
          WHEN 1 THEN ' cheapest under budget' WHEN 2 THEN ' recommend the best'
          WHEN 3 THEN ' any discount deal' WHEN 4 THEN ' most popular by rating' ELSE '' END AS question
        FROM msgs WHERE role = 'user'""",
    "reqs0": """SELECT p_partkey AS request_id,
        CASE WHEN p_partkey % 61 <> 0 THEN p_brand || ' ' || p_name END AS product_name,
        CASE WHEN p_partkey % 5 = 0 THEN 'Electronics|Headphones' WHEN p_partkey % 7 = 0 THEN ''
          ELSE p_type || '|' || split_part(p_name, ' ', 2) END AS category,
        CASE WHEN p_partkey % 53 = 0 THEN -1.0 ELSE floor(p_retailprice * p_size / 3) END AS actual_price,
        coalesce(CASE WHEN p_partkey % 43 <> 0 THEN p_size / 9.0 END, 4.0) AS rating,
        coalesce(CASE WHEN p_partkey % 41 <> 0 THEN CAST(p_size AS BIGINT) * 60 - 100 END, 100) AS rating_count,
        coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_name END, '') AS about_product, '' AS review_content FROM part""",
    "reqs": """SELECT *, concat_ws('; ',
          CASE WHEN product_name IS NULL THEN 'product_name is missing' END,
          CASE WHEN actual_price < 0 THEN 'actual_price must be 0 or more' END,
          CASE WHEN rating NOT BETWEEN 0 AND 5 THEN 'rating must be 0 to 5' END,
          CASE WHEN rating_count < 0 THEN 'rating_count must be 0 or more' END) AS reason FROM reqs0""",
    "serving": f"""SELECT request_id,
        CASE WHEN str_split(category, '|')[1] <> '' THEN str_split(category, '|')[1] ELSE 'Electronics' END AS main_category,
        CASE WHEN str_split(category, '|')[2] <> '' THEN str_split(category, '|')[2]
          ELSE 'Accessories&Peripherals' END AS sub_category,
        split_part(product_name, ' ', 1) AS brand,
        {price_bucket('actual_price', 'left')} AS price_bucket, {rating_bucket('rating', 'left')} AS rating_bucket,
        CAST(actual_price AS DOUBLE) AS actual_price_clean, CAST(rating AS DOUBLE) AS rating_clean,
        ln(1 + rating_count) AS rating_count_log, CAST(length(about_product) AS DOUBLE) AS about_product_length,
        CAST(length(review_content) AS DOUBLE) AS review_content_length, ln(1 + actual_price) AS price_log,
        CAST(100 AS DOUBLE) AS category_popularity, CAST(50 AS DOUBLE) AS brand_popularity,
        CAST(rating_count > 1000 AS DOUBLE) AS high_engagement,
        ln(1 + actual_price) * rating AS price_rating_interaction,
        rating * ln(1 + rating_count) AS engagement_score FROM reqs WHERE reason = ''""",
    "ev": """SELECT event_id, ts, CASE event_type WHEN 'purchase' THEN 'prediction' WHEN 'view' THEN 'query'
          WHEN 'error' THEN 'error' ELSE 'retrain' END AS kind,
        CASE event_type WHEN 'purchase' THEN 'predict' WHEN 'view' THEN 'query' END AS endpoint,
        CASE WHEN event_type = 'purchase' THEN least(value, 100.0) END AS prediction,
        CASE WHEN event_type IN ('purchase', 'view') THEN value / 100 END AS latency,
        CASE WHEN event_type = 'view' THEN substr(props, 1, 100) END AS query,
        CASE WHEN event_type = 'view' THEN
          CASE WHEN value > 70 THEN 'high' WHEN value > 50 THEN 'medium' ELSE 'low' END END AS confidence,
        CASE WHEN event_type = 'view' THEN 'user_' || user_id END AS session_id,
        CASE WHEN event_type = 'error' THEN
          CASE WHEN user_id % 2 = 0 THEN 'prediction_error' ELSE 'rag_error' END END AS error_type,
        CASE WHEN event_type IN ('error', 'signup') THEN props END AS message
        FROM events WHERE event_type <> 'click'""",
    "recent": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, event_id DESC) AS recency
        FROM ev WHERE kind IN ('prediction', 'query')) WHERE recency <= 100""",
    "ref": f"""SELECT avg(prediction) AS pred_mean, stddev_pop(prediction) AS pred_std, min(prediction) AS pred_min,
        max(prediction) AS pred_max, count(prediction) AS pred_count
        FROM ev WHERE kind = 'prediction' AND ts < {SPLIT}""",
    "cur": f"""SELECT event_id, prediction FROM ev WHERE kind = 'prediction' AND ts >= {SPLIT}
        ORDER BY ts DESC, event_id DESC LIMIT 1000""",
    "binned": """SELECT CASE WHEN prediction = pred_mean + 3 * pred_std THEN 9
          WHEN prediction >= pred_mean - 3 * pred_std AND prediction < pred_mean + 3 * pred_std
          THEN least(CAST(floor((prediction - (pred_mean - 3 * pred_std)) / (6 * pred_std / 10)) AS INTEGER), 9)
          END AS bin_id FROM cur, ref""",
    "bins": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, {s})" for i, s in enumerate(SHARES + SHARES[::-1])) + ") AS t(bin_id, share)",
    "hist": """SELECT b.bin_id, CAST(b.share AS DOUBLE) AS reference_share,
        least(greatest(count(c.bin_id) / ((SELECT count(*) FROM cur) + 1e-10), 0.001), 1.0) AS current_share
        FROM bins b LEFT JOIN binned c ON c.bin_id = b.bin_id GROUP BY b.bin_id, b.share""",
    "psi_row": """SELECT greatest(sum((current_share - reference_share) * ln(current_share / reference_share)), 0.0) AS psi
        FROM hist""",
    "drift": """SELECT *, CASE WHEN pred_count = 0 THEN 'no_reference' WHEN samples_analyzed < 100
            THEN 'insufficient_data' WHEN moved THEN 'drift_detected' ELSE 'ok' END AS status,
          pred_count > 0 AND samples_analyzed >= 100 AND moved AS drift_detected
        FROM (SELECT *, m > 0.1 OR s > 0.1 OR psi > 0.2 AS moved FROM (
          SELECT abs(c.mean - pred_mean) / (pred_std + 1e-10) AS m, abs(c.std - pred_std) / (pred_std + 1e-10) AS s,
            psi, c.mean, pred_mean, pred_count, c.n AS samples_analyzed
          FROM (SELECT avg(prediction) AS mean, stddev_pop(prediction) AS std, count(*) AS n FROM cur) c, ref, psi_row))""",
    "shown": "SELECT status, drift_detected, samples_analyzed, " + ", ".join(
        f"CASE WHEN pred_count > 0 AND samples_analyzed >= 100 THEN round({v}, {n}) END AS {name}"
        for v, n, name in (("m", 4, "mean_drift"), ("s", 4, "std_drift"), ("psi", 4, "psi"),
                           ("mean", 2, "current_mean"), ("pred_mean", 2, "reference_mean"))) + " FROM drift",
    "tot": """SELECT count(*) FILTER (kind = 'prediction') AS total_predictions,
        count(*) FILTER (kind = 'query') AS total_queries, count(*) FILTER (kind = 'error') AS total_errors FROM ev""",
    "lat": """SELECT endpoint, avg(latency) AS avg, quantile_cont(latency, 0.5) AS p50, quantile_cont(latency, 0.95) AS p95,
        quantile_cont(latency, 0.99) AS p99, count(*) AS count FROM (
          SELECT endpoint, latency FROM recent UNION ALL SELECT 'all', latency FROM recent) GROUP BY endpoint""",
    "every_hit": f"""SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {cosine('q.embedding', 'd.embedding')} AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY {cosine('q.embedding', 'd.embedding')} DESC, d.vec_id) AS rank
        FROM embeddings q, embeddings d QUALIFY rank <= 5""",
    "vec_docs": """SELECT t.*, e.embedding FROM texts t JOIN embeddings e
        ON e.vec_id = t.ord % (SELECT count(*) FROM embeddings)""",
    "vec_asks": """SELECT a.*, e.embedding FROM asks a JOIN embeddings e
        ON e.vec_id = a.query_id % (SELECT count(*) FROM embeddings)""",
    "scored": f"""SELECT q.query_id, d.product_id AS doc_id, {cosine('q.embedding', 'd.embedding')} AS score
        FROM vec_asks q, vec_docs d""",
    "hits": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
        FROM scored) WHERE rank <= 8 AND score >= 0.0""",
    "hit_lines": f"""SELECT query_id, rank, i, {stripped('l')} AS line FROM (
        SELECT query_id, rank, unnest(str_split('Product ' || rank || ':' || chr(10) || rag_document, chr(10))) AS l,
          generate_subscripts(str_split('Product ' || rank || ':' || chr(10) || rag_document, chr(10)), 1) AS i
        FROM hits JOIN texts ON doc_id = product_id WHERE rank <= 5)""",
    "hit_fields": """SELECT query_id, rank, block, i,
          replace(lower(rtrim(substr(line, 1, position(':' IN line) - 1))), ' ', '_') AS key,
          ltrim(substr(line, position(':' IN line) + 1)) AS value
        FROM (SELECT *, sum(CAST(line = '' AS INTEGER)) OVER (PARTITION BY query_id, rank ORDER BY i) AS block
          FROM hit_lines) WHERE contains(line, ':')""",
    "products": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, block) AS pos FROM (
        SELECT query_id, rank, block, """ + ", ".join(
        f"arg_max(value, i) FILTER (key = '{k}') AS {k}"
        for k in ("product", "sale_price", "discount", "rating", "brand"))
        + " FROM hit_fields GROUP BY query_id, rank, block)",
    "ranked": f"""SELECT *, count(*) OVER (PARTITION BY query_id) AS n,
        row_number() OVER (PARTITION BY query_id ORDER BY {first_number("coalesce(sale_price, '999999')")}, pos) AS by_price,
        row_number() OVER (PARTITION BY query_id ORDER BY {first_number("coalesce(rating, '0')")} DESC, pos) AS by_rating,
        row_number() OVER (PARTITION BY query_id ORDER BY {first_number("coalesce(discount, '0%')")} DESC, pos) AS by_discount
        FROM products""",
}

_N = "coalesce(product, 'Unknown')"
_ONE = "substr(" + _N + ", 1, 40)"
_PRICE, _RATE = "coalesce(sale_price, 'N/A')", "coalesce(rating, 'N/A')"
_OFF = "coalesce(discount, 'N/A')"
CTES["listed"] = f"""SELECT query_id,
    'The most affordable option is **' || max(substr({_N}, 1, 50)) FILTER (by_price = 1) || '** at ' ||
      max({_PRICE}) FILTER (by_price = 1) || ' (' || max(coalesce(discount, '0%')) FILTER (by_price = 1) ||
      ' off). Rating: ' || max({_RATE}) FILTER (by_price = 1) AS cheapest,
    'Here are products sorted by price:' || chr(10) || chr(10) ||
      string_agg(by_price || '. **' || {_ONE} || '** - ' || {_PRICE} || chr(10), '' ORDER BY by_price)
      FILTER (by_price <= 5) AS prices,
    'Based on ratings, I recommend **' || max({_N}) FILTER (by_rating = 1) || '**.' || chr(10) || chr(10) ||
      '• Price: ' || max({_PRICE}) FILTER (by_rating = 1) || ' (' || max({_OFF}) FILTER (by_rating = 1) || ')' || chr(10) ||
      '• Rating: ' || max({_RATE}) FILTER (by_rating = 1) || chr(10) ||
      '• Brand: ' || max(coalesce(brand, 'N/A')) FILTER (by_rating = 1) || chr(10) ||
      CASE WHEN count(*) > 1 THEN chr(10) || '**Other options:**' || chr(10) ||
        string_agg('• ' || {_ONE} || ' - ' || {_RATE} || chr(10), '' ORDER BY by_rating)
        FILTER (by_rating IN (2, 3)) ELSE '' END AS recommend,
    'Best discount deals:' || chr(10) || chr(10) ||
      string_agg(by_discount || '. **' || {_ONE} || '** - ' || {_OFF} || ' off (Now ' || {_PRICE} || ')' || chr(10), ''
        ORDER BY by_discount) FILTER (by_discount <= 5) AS discounts,
    'Top-rated products:' || chr(10) || chr(10) ||
      string_agg(by_rating || '. **' || {_ONE} || '** - ⭐ ' || {_RATE} || chr(10), '' ORDER BY by_rating)
      FILTER (by_rating <= 5) AS ratings,
    'I found ' || count(*) || ' relevant products (sorted by reviews):' || chr(10) || chr(10) ||
      string_agg('**' || by_rating || '. ' || {_N} || '**' || chr(10) || '   • Price: ' || {_PRICE} || ' (' || {_OFF} ||
        ')' || chr(10) || '   • Rating: ' || {_RATE} || chr(10) || chr(10), '' ORDER BY by_rating)
      FILTER (by_rating <= 5) AS general
    FROM ranked GROUP BY query_id"""

_NAME = re.compile(r"\b(" + "|".join(CTES) + r")\b")


def sql(body: str) -> str:
    """``body`` with the derived tables it uses, in order."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        for name in _from_names(todo.pop()):
            if name not in needed:
                needed.add(name)
                todo.append(CTES[name])
    parts = ",\n".join(f"{name} AS ({text})" for name, text in CTES.items() if name in needed)
    return f"WITH {parts}\n{body}" if parts else body


def _from_names(text: str) -> set[str]:
    clauses = re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+(?:\s+[a-z]\b)?(?:\s*,\s*[a-z_0-9]+(?:\s+[a-z]\b)?)*)", text)
    names = {word for clause in clauses for word in re.findall(r"[a-z_0-9]+", clause)}
    if ") c, ref, psi_row" in text:
        names |= {"ref", "psi_row"}
    return names & CTES.keys()


def iso(column: str) -> str:
    return f"strftime({column}, {ISO}) AS {column}"


def columns(names: list[str], places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in names)


SESSION_ROWS = f"SELECT session_id, {iso('created_at')}, {iso('last_activity')}, message_count FROM sess"
MESSAGE_ROWS = f"SELECT id, session_id, role, content, {iso('ts')} FROM msgs"
ANSWER = "SELECT a.query_id, {0} AS answer FROM asks a LEFT JOIN listed l ON l.query_id = a.query_id"
CHEAP = "CASE WHEN regexp_matches(lower(a.question), 'cheap|under|budget') THEN cheapest ELSE prices END"
DRIFT_ROW = """SELECT status, drift_detected, round(mean_drift, 3) AS mean_drift, round(std_drift, 3) AS std_drift,
  round(psi, 3) AS psi, round(current_mean, 3) AS current_mean, round(reference_mean, 3) AS reference_mean,
  samples_analyzed FROM shown"""
ROLLING_COUNTS = ", ".join(f"count(*) FILTER (bin_id = {i}) OVER w AS c{i}" for i in range(10))
ROLLING_PSI = " + ".join(
    "({0} - {1}) * ln({0} / {1})".format(f"least(greatest(c{i} / (n + 1e-10), 0.001), 1.0)", f"CAST({s} AS DOUBLE)")
    for i, s in enumerate(SHARES + SHARES[::-1]))
INDEX_FIELDS = """product_id AS id, product_name, brand, main_category AS category,
        CAST(round_even(discount_percentage, 0) AS BIGINT) || '%' AS discount"""
CLEARED = "session_id IN ('user_3', 'user_8')"
#: Sessions that a stream keeps: not two days behind the newest message less the hour of lateness.
LIVE = "last_activity >= (SELECT max(ts) FROM msgs) - INTERVAL 1 HOUR - INTERVAL 2 DAY"
BY_SESSION = "OVER (PARTITION BY session_id ORDER BY ts, id)"
BACK = "OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC)"
REASON = "concat_ws('; ', CASE WHEN {0} THEN '{1}' END, CASE WHEN {2} THEN '{3}' END)"
PREVIOUS = """coalesce(
  CASE WHEN lag(role, 1) {w} = 'user' THEN lag({c}, 1) {w} END,
  CASE WHEN lag(role, 2) {w} = 'user' THEN lag({c}, 2) {w} END)"""
CLASSES = [
    ("minimal_discount", "Low discount recommended. Product has strong demand or premium positioning.",
     "Consider maintaining current price or minimal promotional discount."),
    ("moderate_discount", "Standard promotional discount suitable.",
     "Apply 20-35% discount for effective promotion."),
    ("significant_discount", "Higher discount indicated due to competitive pressure or inventory needs.",
     "Consider bundle offers or seasonal promotions."),
    ("deep_discount", "Deep discount suggested. Review pricing strategy.",
     "Evaluate clearance options or price repositioning."),
]


def by_class(i: int) -> str:
    a, b, c, d = (row[i] for row in CLASSES)
    return (f"CASE WHEN prediction < 15 THEN '{a}' WHEN prediction < 35 THEN '{b}' "
            f"WHEN prediction < 55 THEN '{c}' ELSE '{d}' END")


def known(column: str, default: str) -> str:
    return f"""CASE WHEN {column} IN (SELECT {column} FROM clean) THEN {column}
      WHEN EXISTS (SELECT 1 FROM clean WHERE {column} = '{default}') THEN '{default}'
      ELSE (SELECT min({column}) FROM clean) END AS {column}"""


def top_products(order: str, field: str) -> str:
    return f"SELECT query_id, {order} AS place, product, {field} FROM ranked WHERE {order} <= 5"


_BODIES = {
    "S1_csv_products": """SELECT 'U' || ord AS user_id, product_id, product_name, category, discounted_price, actual_price,
        discount_percentage, CASE WHEN rating <> 'N/A' THEN rating END AS rating, rating_count,
        md5(about_product) AS about_product_md5, md5(review_content) AS review_content_md5 FROM raw""",
    "S1_split_csv": """SELECT 'U' || ord AS user_id, product_id, product_name, category, discounted_price, actual_price,
        discount_percentage, CASE WHEN rating <> 'N/A' THEN rating END AS rating, rating_count,
        md5(about_product) AS about_product_md5, md5(review_content) AS review_content_md5 FROM raw""",
    "S2_table_products": "SELECT ord, product_id, brand, actual_price_clean, discount_percentage FROM clean",
    "S3_clustered_log": SESSION_ROWS,
    "S4_append_messages": MESSAGE_ROWS,
    "S5_session_messages": f"SELECT id, role, content, {iso('ts')} FROM msgs WHERE session_id = 'user_5'",
    "S6_recent_sessions": f"""SELECT m.session_id, id, role, content, {iso('ts')}, {iso('created_at')},
        {iso('last_activity')}, message_count FROM msgs m JOIN
        (SELECT * FROM sess ORDER BY last_activity DESC, session_id LIMIT 20) s ON s.session_id = m.session_id""",
    "S7_saved_encoders": None,
    "S9_saved_vectors": """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimension,
        round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm
        FROM embeddings""",
    "S10_saved_conversations": MESSAGE_ROWS,
    "S14_exported_metrics": f"""SELECT CASE kind WHEN 'prediction' THEN 'discount_predictions_total'
          WHEN 'query' THEN 'rag_queries_total' ELSE 'errors_total' END AS metric, coalesce(error_type, '') AS label,
        CAST(count(*) AS DOUBLE) AS value FROM ev WHERE kind <> 'retrain' GROUP BY ALL
        UNION ALL SELECT 'request_latency_seconds_bucket', endpoint || ' le=' || le, CAST(n AS DOUBLE) FROM (
          {" UNION ALL ".join(f"SELECT endpoint, '{e}' AS le, count(*) FILTER (latency <= {e}) AS n FROM ev WHERE endpoint IS NOT NULL GROUP BY endpoint" for e in EDGES)}
          UNION ALL SELECT endpoint, '+Inf', count(*) FROM ev WHERE endpoint IS NOT NULL GROUP BY endpoint)
        UNION ALL SELECT 'request_latency_seconds_sum', endpoint, round(sum(latency), 4) FROM ev
          WHERE endpoint IS NOT NULL GROUP BY endpoint
        UNION ALL SELECT 'request_latency_seconds_count', endpoint, CAST(count(*) AS DOUBLE) FROM ev
          WHERE endpoint IS NOT NULL GROUP BY endpoint
        UNION ALL SELECT 'last_prediction_value', '', round(arg_max(prediction, (ts, event_id)), 4) FROM ev
          WHERE kind = 'prediction'
        UNION ALL SELECT 'drift_score', '', 0.0""",
    "P1_clean_price": f"""SELECT ord, {price_of('actual_price')} AS actual_price_clean,
        {price_of('discounted_price')} AS discounted_price_clean FROM raw""",
    "P2_clean_percentage": f"SELECT ord, {DISCOUNT} AS discount_percentage FROM raw",
    "P3_clean_rating": f"SELECT ord, {RATING} AS rating_clean FROM raw",
    "P4_clean_rating_count": f"SELECT ord, {COUNT} AS rating_count_clean FROM raw",
    "P5_category_levels": f"""SELECT ord, {level(1)} AS main_category, {level(2)} AS sub_category,
        {level(3)} AS sub_sub_category FROM raw""",
    "P6_brand": f"SELECT ord, {BRAND} AS brand FROM raw",
    "P7_text_lengths": """SELECT ord, length(coalesce(about_product, '')) AS about_product_length,
        length(coalesce(review_content, '')) AS review_content_length,
        length(coalesce(product_name, '')) AS product_name_length FROM raw""",
    "P8_logs": f"SELECT ord, {columns(['price_log', 'rating_count_log'])} FROM feat",
    "P9_price_bucket": f"SELECT ord, {price_bucket(price_of('actual_price'))} AS price_bucket FROM raw",
    "P10_rating_bucket": f"SELECT ord, {rating_bucket(RATING)} AS rating_bucket FROM raw",
    "P11_price_rating": f"SELECT ord, {columns(['price_rating_interaction'])} FROM feat",
    "P12_engagement_score": f"SELECT ord, {columns(['engagement_score'])} FROM feat",
    "P13_document_text": "SELECT ord, rag_document FROM texts",
    "P14_serving_buckets": "SELECT request_id, price_bucket, rating_bucket FROM serving",
    "P15_serving_row": f"SELECT request_id, {', '.join(CATEGORICAL)}, {columns(NUMERIC)} FROM serving",
    "P16_first_number": f"""SELECT ord, {first_number("coalesce(actual_price, '')")} AS price_number,
        {first_number("coalesce(product_name, '')")} AS name_number FROM raw""",
    "P17_field_table": f"""SELECT ord, CAST(dense_rank() OVER (PARTITION BY ord ORDER BY block) - 1 AS INTEGER) AS record,
        field, arg_max(value, i) AS value FROM (
          SELECT ord, block, i, replace(lower(rtrim(substr(line, 1, position(':' IN line) - 1))), ' ', '_') AS field,
            ltrim(substr(line, position(':' IN line) + 1)) AS value
          FROM (SELECT *, sum(CAST(line = '' AS INTEGER)) OVER (PARTITION BY ord ORDER BY i) AS block FROM (
            SELECT ord, i, {stripped('l')} AS line FROM (SELECT ord, unnest(str_split(rag_document, chr(10))) AS l,
              generate_subscripts(str_split(rag_document, chr(10)), 1) AS i FROM texts)))
          WHERE contains(line, ':')) GROUP BY ord, block, field""",
    "P18_context_line": f"SELECT id, {LINE} AS line FROM msgs",
    "P19_query_excerpt": "SELECT id, substr(content, 1, 100) AS query FROM msgs",
    "P20_previews": f"""SELECT id, substr(content, 1, 80) AS message, substr(content, 1, 100) AS message_preview,
        strftime(ts, {ISO}) AS time FROM msgs""",
    "P21_clip": "SELECT event_id, least(greatest(value * 2 - 50, 0.0), 100.0) AS prediction FROM events",
    "P22_interval": """SELECT event_id,
        round(least(greatest(prediction - 1.96 * 15.5, 0.0), 100.0), 6) AS confidence_lower,
        round(least(greatest(prediction + 1.96 * 15.5, 0.0), 100.0), 6) AS confidence_upper
        FROM ev WHERE kind = 'prediction'""",
    "P23_explanation": f"""SELECT event_id, {by_class(0)} AS category, {by_class(1)} AS explanation,
        {by_class(2)} AS recommendation FROM ev WHERE kind = 'prediction'""",
    "P24_suggested_price": """SELECT ord, round(actual_price_clean * (1 - discount_percentage / 100), 6) AS suggested_price
        FROM clean""",
    "P25_score_badge": """SELECT event_id, CASE WHEN value / 100 > 0.7 THEN 'high' WHEN value / 100 > 0.5 THEN 'medium'
        ELSE 'low' END AS badge FROM events""",
    "P26_confidence": """SELECT query_id, CASE WHEN avg(score) > 0.7 THEN 'high' WHEN avg(score) > 0.5 THEN 'medium'
        ELSE 'low' END AS confidence FROM hits GROUP BY query_id""",
    "P27_rounded_results": """SELECT l_partkey, round(avg(l_extendedprice * l_discount), 2) AS two,
        round(avg(l_discount), 4) AS four FROM lineitem GROUP BY l_partkey""",
    "P28_percent_text": """SELECT ord, CAST(round_even(discount_percentage, 0) AS BIGINT) || '%' AS discount FROM clean""",
    "P29_days_since": f"""SELECT event_id, CAST(floor((epoch_us({NOW}) - epoch_us(ts)) // 1000000 / 86400) AS BIGINT) AS days
        FROM events""",
    "P30_unit_vectors": """SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(x / (norm + 1e-10), 10) AS x FROM (
        SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i, sqrt(list_dot_product(v, v)) AS norm FROM (
          SELECT vec_id, [CAST(y AS DOUBLE) * 3 FOR y IN embedding] AS v FROM embeddings))""",
    "F1_positive_price": f"""SELECT ord, {price_of('actual_price')} AS actual_price_clean FROM raw
        WHERE {price_of('actual_price')} > 0""",
    "F2_discount_range": f"SELECT ord, {DISCOUNT} AS discount_percentage FROM raw WHERE {DISCOUNT} BETWEEN 0 AND 100",
    "F3_known_id": "SELECT ord, product_id FROM raw WHERE product_id IS NOT NULL",
    "F4_category_pattern": "SELECT ord, main_category FROM clean WHERE regexp_matches(main_category, '(?i)econ|^s')",
    "F5_score_threshold": "SELECT query_id, doc_id, rank FROM every_hit WHERE score >= 0.3",
    "F6_message_search": f"""SELECT session_id, role, substr(content, 1, 100) AS message_preview,
        strftime(ts, {ISO}) AS time FROM msgs WHERE translate(content,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%ció%' ORDER BY ts DESC, id DESC LIMIT 20""",
    "F7_last_user_message": f"""SELECT session_id, arg_min(content, back) AS last_user_message FROM (
        SELECT *, row_number() {BACK} AS back FROM msgs) WHERE back <= 2 AND role = 'user' GROUP BY session_id""",
    "F8_expired_sessions": f"SELECT session_id FROM sess WHERE last_activity < {RETENTION_NOW} - INTERVAL 30 DAY",
    "F9_rejected_products": "SELECT request_id, reason FROM reqs WHERE reason <> ''",
    "F9_valid_questions": """SELECT query_id, session_id, top_k, true AS include_sources FROM asks
        WHERE length(question) >= 3 AND top_k BETWEEN 1 AND 20""",
    "F9_rejected_pages": "SELECT id, reason FROM (SELECT id, " + REASON.format(
        "length(content) % 120 NOT BETWEEN 1 AND 100", "limit must be 1 to 100",
        "id % 7 - 2 < 0", "offset must be 0 or more") + " AS reason FROM msgs) WHERE reason <> ''",
    "F10_keyword_groups": f"SELECT query_id, {INTENT.format(q='question')} AS intent FROM asks",
    "J1_popularity": "SELECT ord, category_popularity, brand_popularity FROM feat",
    "J2_label_codes": f"SELECT ord, {', '.join(CATEGORICAL)} FROM coded",
    "J3_scores": "SELECT query_id, doc_id, round(score, 4) AS score, rank FROM every_hit",
    "M12_retrieve": """SELECT query_id, doc_id, round(score, 4) AS score, rank FROM hits
        WHERE rank <= 5 AND score >= 0.3""",
    "J4_hit_documents": """SELECT query_id, rank, doc_id, product_name, discounted_price AS price, rating
        FROM hits JOIN clean ON doc_id = product_id""",
    "J6_session_list": f"""SELECT session_id,
        CASE WHEN message_count > 4 THEN message_count ELSE least(message_count, 4) END AS message_count,
        least(message_count, 4) // 2 AS turns,
        CASE WHEN message_count > 4 THEN strftime(created_at, {ISO}) END AS created_at,
        CASE WHEN message_count > 4 THEN strftime(last_activity, {ISO}) END AS last_activity FROM sess""",
    "J7_unexpired_messages": f"""SELECT id, session_id FROM msgs WHERE session_id NOT IN (
        SELECT session_id FROM sess WHERE last_activity < {RETENTION_NOW} - INTERVAL 30 DAY)""",
    "G13_file_retention": f"""SELECT id, session_id FROM msgs WHERE session_id NOT IN (
        SELECT session_id FROM sess WHERE last_activity < {RETENTION_NOW} - INTERVAL 30 DAY)""",
    "J8_cleared_messages": f"SELECT id, session_id FROM msgs WHERE NOT ({CLEARED})",
    "J8_file_clear": f"SELECT id, session_id FROM msgs WHERE NOT ({CLEARED})",
    "J9_known_values": f"""SELECT request_id, {known('main_category', 'Electronics')},
        {known('sub_category', 'Accessories&Peripherals')}, {known('brand', 'boAt')} FROM serving""",
    "J10_bin_shares": "SELECT bin_id, round(reference_share, 6) AS reference_share, round(current_share, 6) AS current_share FROM hist",
    "J11_current_and_reference": """SELECT round(mean_drift, 3) AS mean_drift, round(std_drift, 3) AS std_drift,
        round(current_mean, 3) AS current_mean, round(reference_mean, 3) AS reference_mean FROM shown""",
    "A1_catalogue_stats": """SELECT count(*) AS total_products, count(DISTINCT brand) AS unique_brands,
        count(DISTINCT main_category) AS unique_categories, round(avg(actual_price_clean), 4) AS price_mean,
        round(stddev_samp(actual_price_clean), 4) AS price_std, round(avg(discount_percentage), 4) AS discount_mean,
        round(stddev_samp(discount_percentage), 4) AS discount_std FROM clean""",
    "A2_category_distribution": "SELECT main_category, count(*) AS products FROM clean GROUP BY main_category",
    "A3_distinct_counts": """SELECT count(*) AS products, count(DISTINCT main_category) AS categories,
        count(DISTINCT brand) AS brands FROM clean""",
    "A4_value_ranges": """SELECT min(actual_price_clean) AS price_min, max(actual_price_clean) AS price_max,
        round(avg(actual_price_clean), 4) AS price_mean, min(discount_percentage) AS discount_min,
        max(discount_percentage) AS discount_max, round(avg(discount_percentage), 4) AS discount_mean FROM clean""",
    "A5_engagement_flag": "SELECT ord, high_engagement FROM feat",
    "A6_mode_fill": """SELECT ord, coalesce(category, (SELECT category FROM raw WHERE category IS NOT NULL
        GROUP BY category ORDER BY count(*) DESC, category LIMIT 1)) AS category FROM raw""",
    "A7_label_table": " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS feature, {c} AS label, dense_rank() OVER (ORDER BY {c}) - 1 AS code FROM feat"
        for c in CATEGORICAL),
    "A8_standardised": "SELECT product_id, " + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END, 6) AS {c}"
        for c in INPUTS) + " FROM coded",
    "A9_session_rollup": SESSION_ROWS,
    "A10_turns": "SELECT session_id, message_count // 2 AS turns FROM sess",
    "A11_store_totals": """SELECT 'Total Sessions' AS metric, CAST(count(*) AS VARCHAR) AS value FROM sess
        UNION ALL SELECT 'Total Messages', CAST(count(*) AS VARCHAR) FROM msgs
        UNION ALL SELECT 'Avg Messages/Session', CAST(CAST(trunc(avg(message_count)) AS BIGINT) AS VARCHAR) FROM sess
        UNION ALL SELECT 'Most Active Session', (SELECT session_id FROM sess ORDER BY message_count DESC, session_id LIMIT 1)""",
    "A12_message_ranking": """SELECT session_id, message_count AS msg_count FROM sess
        ORDER BY message_count DESC, session_id LIMIT 10""",
    "A13_totals": "SELECT * FROM tot",
    "A14_latency_stats": f"SELECT endpoint, {columns(['avg', 'p50', 'p95', 'p99'], 9)}, count FROM lat",
    "A15_error_rate": """SELECT total_predictions, total_errors, round(total_errors / total_predictions, 6) AS error_rate,
        total_errors / total_predictions > 0.05 AS high_error_rate FROM tot""",
    "A16_reference_stats": f"""SELECT {columns(['pred_mean', 'pred_std', 'pred_min', 'pred_max'])}, pred_count FROM ref""",
    "A16_feature_reference": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 4) AS feature_mean, round(stddev_pop({c}), 4) AS feature_std FROM feat"
        for c in NUMERIC),
    "A17_mean_score": """SELECT query_id, round(avg(score), 6) AS mean_score, count(*) AS num_sources FROM hits
        GROUP BY query_id""",
    "A18_drift": DRIFT_ROW,
    "A19_psi": "SELECT round(psi, 4) AS psi FROM psi_row",
    "A20_model_drift": f"""SELECT n >= 100 AND (m > 0.5 OR s > 0.5) AS drift_detected,
        CASE WHEN n < 100 THEN 'Insufficient data' END AS reason,
        CASE WHEN n >= 100 THEN round(m, 4) END AS mean_drift, CASE WHEN n >= 100 THEN round(s, 4) END AS std_drift,
        CASE WHEN n >= 100 THEN round(pred_mean, 4) END AS reference_mean,
        CASE WHEN n >= 100 THEN round(mean, 4) END AS current_mean,
        CASE WHEN n >= 100 THEN n END AS samples_analyzed FROM (
          SELECT *, abs(mean - pred_mean) / (pred_std + 1e-10) AS m, abs(std - pred_std) / (pred_std + 1e-10) AS s
          FROM ref, (SELECT avg(prediction) AS mean, stddev_pop(prediction) AS std, count(*) AS n FROM (
            SELECT prediction FROM ev WHERE kind = 'prediction' AND ts >= {SPLIT}
            ORDER BY ts DESC, event_id DESC LIMIT 100)))""",
    "A21_regression_metrics": """SELECT round(sqrt(avg(e * e)), 6) AS val_rmse, round(avg(abs(e)), 6) AS val_mae,
        round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS val_r2 FROM (
          SELECT discount_percentage AS y,
            discount_percentage - least(greatest(rating_clean * 15 - 5, 0.0), 100.0) AS e FROM clean)""",
    "A22_counters": """SELECT CASE kind WHEN 'prediction' THEN 'discount_predictions_total'
          WHEN 'query' THEN 'rag_queries_total' ELSE 'errors_total' END AS metric, coalesce(error_type, '') AS type,
        count(*) AS value FROM ev WHERE kind <> 'retrain' GROUP BY ALL""",
    "A23_latency_histogram": "SELECT endpoint, le, cumulative_count, latency_sum, latency_count FROM (" + " UNION ALL ".join(
        f"""SELECT endpoint, '{label}' AS le, count(*) FILTER ({test}) AS cumulative_count,
        round(sum(latency), 4) AS latency_sum, count(*) AS latency_count FROM ev WHERE endpoint IS NOT NULL GROUP BY endpoint"""
        for label, test in [(str(e), f"latency <= {e}") for e in EDGES] + [("+Inf", "true")]) + ")",
    "A24_gauges": """SELECT 'last_prediction_value' AS metric, arg_max(prediction, (ts, event_id)) AS value FROM ev
        WHERE kind = 'prediction' UNION ALL SELECT 'drift_score', 0.0""",
    "A26_system_stats": """SELECT (SELECT count(*) FROM embeddings) AS total_documents,
        (SELECT CAST(max(len(embedding)) AS INTEGER) FROM embeddings) AS embedding_dimension,
        (SELECT count(*) FROM asks) AS total_queries, (SELECT count(*) FROM sess) AS active_sessions,
        false AS llm_enabled""",
    "A27_table_counts": """SELECT 'sessions' AS table_name, count(*) AS rows FROM sess
        UNION ALL SELECT 'messages', count(*) FROM msgs""",
    "W1_first_per_name": "SELECT ord, product_name FROM named",
    "S2_arriving_first_rows": "SELECT ord, product_name FROM named",
    "W2_retained_messages": f"SELECT session_id, id FROM msgs QUALIFY row_number() {BACK} <= 4",
    "W3_context_text": f"""SELECT session_id, 'Previous conversation:' || chr(10) ||
        string_agg({LINE}, chr(10) ORDER BY ts, id) AS context FROM (
          SELECT * FROM msgs QUALIFY row_number() {BACK} <= 6) GROUP BY session_id""",
    "W4_contextual_query": f"""SELECT id, coalesce(said || ' ', '') || content AS query FROM (
        SELECT *, {PREVIOUS.format(w=BY_SESSION, c='content')} AS said FROM msgs) WHERE role = 'user'""",
    "W5_drift_window": """SELECT event_id, prediction FROM ev WHERE kind = 'prediction'
        ORDER BY ts DESC, event_id DESC LIMIT 1000""",
    "W5_rolling_drift": f"""SELECT event_id, CASE WHEN pred_count = 0 THEN 'no_reference' WHEN n < 100
          THEN 'insufficient_data' WHEN moved THEN 'drift_detected' ELSE 'ok' END AS status,
        pred_count > 0 AND n >= 100 AND moved AS drift_detected, n AS samples_analyzed, """ + ", ".join(
        f"CASE WHEN pred_count > 0 AND n >= 100 THEN round({v}, {places}) END AS {name}"
        for v, places, name in (("m", 4, "mean_drift"), ("s", 4, "std_drift"), ("psi", 4, "psi"),
                                ("pred_mean", 2, "reference_mean"))) + f""" FROM (
        SELECT *, m > 0.1 OR s > 0.1 OR psi > 0.2 AS moved FROM (
          SELECT *, abs(mean - pred_mean) / (pred_std + 1e-10) AS m, abs(std - pred_std) / (pred_std + 1e-10) AS s,
            greatest({ROLLING_PSI}, 0.0) AS psi FROM (
            SELECT event_id, pred_mean, pred_std, pred_count, avg(prediction) OVER w AS mean,
              stddev_pop(prediction) OVER w AS std, count(*) OVER w AS n, {ROLLING_COUNTS} FROM (
              SELECT *, CASE WHEN prediction = pred_mean + 3 * pred_std THEN 9
                WHEN prediction >= pred_mean - 3 * pred_std AND prediction < pred_mean + 3 * pred_std
                THEN least(CAST(floor((prediction - (pred_mean - 3 * pred_std)) / (6 * pred_std / 10)) AS INTEGER), 9)
                END AS bin_id FROM ev, ref WHERE kind = 'prediction' AND ts >= {SPLIT})
            WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW))))""",
    "W6_recent_records": "SELECT kind, event_id, recency FROM recent",
    "W7_recent_errors": """SELECT event_id, error_type, message FROM ev WHERE kind = 'error'
        ORDER BY ts DESC, event_id DESC LIMIT 5""",
    "W8_running_sessions": f"""SELECT id, session_id, row_number() {BY_SESSION} AS message_count,
        strftime(ts, {ISO}) AS last_activity FROM msgs""",
    "W9_feature_windows": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, ord, round({c}, 6) AS value FROM feat QUALIFY row_number() OVER (ORDER BY ord DESC) <= 1000"
        for c in NUMERIC),
    "T1_top_k_labels": f"""SELECT label, doc_id, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, doc_id) AS rank FROM (
          SELECT q.label, d.vec_id AS doc_id, {cosine('q.v', 'd.embedding')} AS score FROM (
            SELECT label, list(CAST(x AS FLOAT) ORDER BY i) AS v FROM (
              SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x,
                generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label) q,
          embeddings d)) WHERE rank <= 5""",
    "T2_latest_sessions": "SELECT session_id, message_count FROM sess ORDER BY last_activity DESC, session_id LIMIT 20",
    "T3_listed_sessions": f"""SELECT session_id, message_count AS msgs, strftime(created_at, {ISO}) AS created,
        strftime(last_activity, {ISO}) AS last_active FROM sess ORDER BY last_activity DESC, session_id LIMIT 20""",
    "T4_message_preview": f"""SELECT role, substr(content, 1, 80) AS message, strftime(ts, {ISO}) AS time FROM msgs
        WHERE session_id = 'user_5'""",
    "T5_product_page": """SELECT ord, product_id, product_name, main_category, discounted_price, actual_price, rating_clean,
        discount_percentage, brand FROM clean WHERE regexp_matches(main_category, '(?i)econ')
        ORDER BY ord LIMIT 100 OFFSET 50""",
    "T5_product_total": "SELECT count(*) AS total FROM clean WHERE regexp_matches(main_category, '(?i)econ')",
    "T7_by_price": top_products("by_price", "sale_price"),
    "T8_by_rating": top_products("by_rating", "rating"),
    "T9_by_discount": top_products("by_discount", "discount"),
    "T12_shown_sources": """SELECT query_id, doc_id, CASE WHEN score > 0.7 THEN 'high' WHEN score > 0.5 THEN 'medium'
        ELSE 'low' END AS badge FROM hits WHERE rank <= 3""",
    "T13_context_documents": "SELECT query_id, doc_id FROM hits WHERE rank <= 5",
    "U3_appended_index": """SELECT vec_id, label,
        round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings""",
    "A14_latency_spans": f"""SELECT strftime(date_trunc('day', ts), {ISO}) AS day, endpoint, count(*) AS count,
        round(avg(latency), 6) AS avg, true AS p50_within, true AS p95_within, true AS p99_within FROM (
          SELECT ts, latency, unnest(['all', CASE WHEN kind = 'prediction' THEN 'predict' ELSE 'query' END]) AS endpoint
          FROM ev WHERE kind IN ('prediction', 'query') AND latency IS NOT NULL) GROUP BY ALL""",
    "S11_saved_retrieval": """SELECT (SELECT count(*) FROM clean) AS total_documents, 384 AS embedding_dimension,
        (SELECT count(*) FROM asks) AS total_queries, (SELECT count(DISTINCT session_id) FROM msgs) AS active_sessions,
        false AS llm_enabled""",
    "S15_training_runs": """SELECT '2024-02-20 00:00:00' AS timestamp, 'xgboost' AS model_type, trigger, 16 AS n_importances,
        true AS has_val_rmse FROM (VALUES (NULL), ('drift')) AS t(trigger)""",
    "M10_text_vectors": """SELECT doc_id, 384 AS dimension,
        CASE WHEN regexp_matches(coalesce(text, ''), '[\\p{L}\\p{N}\\p{M}_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents""",
    "M11_product_index": f"SELECT {INDEX_FIELDS}, discounted_price AS price FROM clean",
    "U3_upserted_index": f"""SELECT {INDEX_FIELDS}, 384 AS dimension,
        CASE WHEN k % 3 = 0 AND k % 2 <> 0 THEN discounted_price || ' old' ELSE discounted_price END AS price
        FROM (SELECT *, CAST(substr(product_id, 2, 8) AS INTEGER) AS k FROM clean)
        WHERE k % 2 = 0 OR k % 5 <> 0 AND k % 7 <> 0""",
    "U3_upsert_figures": """SELECT count(*) FILTER (k % 2 = 0) AS given,
        count(*) FILTER (k % 2 = 0 AND k % 5 = 0) AS new, count(*) FILTER (k % 2 = 0 AND k % 5 <> 0 AND k % 3 = 0) AS changed,
        count(*) FILTER (k % 2 = 0 AND k % 5 <> 0 AND k % 3 <> 0) AS same,
        count(*) FILTER (k % 2 <> 0 AND k % 7 = 0 AND k % 5 <> 0) AS removed,
        count(*) FILTER (k % 2 <> 0 AND k % 7 = 0 AND k % 5 = 0) AS unknown,
        count(*) FILTER (k % 2 = 0 AND (k % 5 = 0 OR k % 3 = 0)) AS encoded
        FROM (SELECT CAST(substr(product_id, 2, 8) AS INTEGER) AS k FROM clean)""",
    "U4_both_endpoints": "SELECT endpoint, round(latency, 6) AS latency FROM recent",
    "G1_add_messages": f"""SELECT session_id, count(*) AS message_count, least(count(*), 4) AS retained_count,
        least(count(*), 4) // 2 AS turns, strftime(max(ts), {ISO}) AS last_activity FROM (
          SELECT session_id, ts FROM msgs UNION ALL
          SELECT session_id, ts + INTERVAL 30 MINUTE FROM msgs WHERE role = 'user') GROUP BY session_id""",
    "G2_history": f"""SELECT session_id, count(*) // 2 AS turns,
        string_agg(role || ': ' || content, chr(10) ORDER BY ts, id) AS messages FROM (
          SELECT * FROM msgs QUALIFY row_number() {BACK} <= 4) GROUP BY session_id""",
    "G4_cleared_view": f"""SELECT session_id, CASE WHEN {CLEARED} THEN 0 ELSE message_count END AS message_count
        FROM sess""",
    "G6_price_answer": ANSWER.format(CHEAP),
    "G7_recommend_answer": ANSWER.format("recommend"),
    "G8_discount_answer": ANSWER.format("discounts"),
    "G9_rating_answer": ANSWER.format("ratings"),
    "G10_general_answer": ANSWER.format("general"),
    "G11_template_answer": ANSWER.format(f"""CASE
        WHEN l.query_id IS NULL THEN 'I couldn''t find relevant products. Please try a different question.'
        ELSE CASE {INTENT.format(q='a.question')} WHEN 'price' THEN {CHEAP} WHEN 'recommend' THEN recommend
          WHEN 'discount' THEN discounts WHEN 'rating' THEN ratings ELSE general END END"""),
    "G11_question_sequence": """SELECT query_id,
        coalesce(lag(question) OVER (PARTITION BY session_id ORDER BY ts, query_id) || ' ', '') || question AS query,
        least(2 * row_number() OVER (PARTITION BY session_id ORDER BY ts, query_id), 20) // 2 AS conversation_turns
        FROM asks""",
    "G13_retained_sessions": f"""SELECT session_id, message_count FROM sess
        WHERE NOT last_activity < {RETENTION_NOW} - INTERVAL 30 DAY""",
    "R1_metric_events": """SELECT event_id, kind, endpoint, round(prediction, 6) AS prediction, round(latency, 6) AS latency,
        query, confidence, session_id, error_type, message FROM ev""",
    "R2_drift_history": f"""SELECT status, strftime({NOW}, {ISO}) AS timestamp FROM shown WHERE drift_detected""",
    "R3_retrain_decision": f"""SELECT reasons <> '' AS should_retrain, reasons, drift_status FROM (
        SELECT status AS drift_status, concat_ws('; ',
          CASE WHEN drift_detected THEN format('Drift detected: mean_drift={{:.4f}}', mean_drift) END,
          CASE WHEN total_errors / total_predictions > 0.05
            THEN format('High error rate: {{:.2f}}%', 100 * total_errors / total_predictions) END,
          CASE WHEN days > 30 THEN 'Time since last retrain: ' || days || ' days' END) AS reasons
        FROM shown, tot, (SELECT (epoch_us({NOW} + INTERVAL 20 DAY) - epoch_us(max(ts))) // 86400000000 AS days
          FROM ev WHERE kind = 'retrain'))""",
    "R5_health": """SELECT CASE WHEN drift_detected OR total_errors > 100 OR p95 > 5 THEN 'unhealthy'
          WHEN total_errors > 50 OR p95 > 2 THEN 'degraded' ELSE 'healthy' END AS status, status AS drift_status,
        total_errors AS error_count, round(p95, 6) AS latency_p95, total_predictions, total_queries
        FROM shown, tot, lat WHERE endpoint = 'all'""",
    "R7_component_health": """SELECT 'healthy' AS status, CASE WHEN (SELECT count(*) FROM clean) > 0 THEN 'healthy'
        ELSE 'unavailable' END AS model, CASE WHEN (SELECT count(*) FROM clean) > 0 THEN 'healthy' ELSE 'unavailable' END AS rag,
        CASE WHEN (SELECT count(*) FROM clean) > 0 THEN 'healthy' ELSE 'unavailable' END AS data""",
    "R8_summary": """SELECT total_predictions, total_queries, total_errors,
        round((SELECT p95 FROM lat WHERE endpoint = 'predict'), 6) AS prediction_p95,
        round((SELECT p95 FROM lat WHERE endpoint = 'query'), 6) AS query_p95,
        (SELECT string_agg(event_id, ',' ORDER BY ts, event_id) FROM (SELECT * FROM ev WHERE kind = 'error'
          ORDER BY ts DESC, event_id DESC LIMIT 5)) AS recent_errors FROM tot""",
    "ST1_session_rollup": SESSION_ROWS,
    "ST2_last_messages": f"""SELECT session_id, row_number() {BY_SESSION} AS place, id, role, content FROM (
        SELECT * FROM msgs QUALIFY row_number() {BACK} <= 4)""",
    "ST3_counts_by_minute": f"""SELECT strftime(date_trunc('minute', ts), {ISO}) AS minute, kind, count(*) AS records,
        round(sum(latency), 6) AS latency_sum, count(*) FILTER (latency <= 0.5) AS le_0_5,
        count(*) FILTER (latency <= 1.0) AS le_1_0 FROM ev GROUP BY ALL""",
    "ST1_live_sessions": f"{SESSION_ROWS} WHERE {LIVE}",
    "ST2_live_rings": f"""SELECT session_id, row_number() {BY_SESSION} AS place, id, role, content FROM (
        SELECT * FROM msgs QUALIFY row_number() {BACK} <= 4)
        WHERE session_id IN (SELECT session_id FROM sess WHERE {LIVE})""",
    "ST3_closed_windows": f"""SELECT strftime(date_trunc('minute', ts), {ISO}) AS minute, kind, count(*) AS records,
        round(sum(latency), 6) AS latency_sum, count(*) FILTER (latency <= 0.5) AS le_0_5,
        count(*) FILTER (latency <= 1.0) AS le_1_0 FROM ev
        WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR GROUP BY ALL""",
    "ST4_drift_watch": DRIFT_ROW,
    "ST6_appended_log": MESSAGE_ROWS,
}

#: Keys whose meaning is that of another key.
SAME = {
    "S7_saved_encoders": "A7_label_table",
    "S7_saved_figures": "A1_catalogue_stats",
    "J5_recent_session_messages": "S6_recent_sessions",
    "T6_newest_search_hits": "F6_message_search",
    "G5_intent": "F10_keyword_groups",
    "W10_hit_rank": "J3_scores",
    "G3_all_sessions": "J6_session_list",
    "M1_model_matrix": "A8_standardised",
    "U1_named_totals": "A11_store_totals",
    "T11_most_active": "A12_message_ranking",
    "R2_drift_status": "A18_drift",
    "U2_table_counts": "A27_table_counts",
    "F8_live_sessions": "ST1_live_sessions",
    "R8_latency_spans": "A14_latency_spans",
    "R4_retrain_event": "S15_training_runs",
    "J3_cells_all": "J3_scores",
    "M11_upserted_index": "U3_upserted_index",
}

ORACLE = {name: sql(body) for name, body in _BODIES.items() if body}
ORACLE |= {name: ORACLE[other] for name, other in SAME.items()}
