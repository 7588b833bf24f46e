"""The registered queries in DuckDB SQL, written from the definitions and not
from the Spark code. Every query is a SELECT over named parts below."""

from __future__ import annotations

import re

P = {  # the parameters of polysem.plans.catalog
    "seed": 42, "min_count": 5, "window": 2, "n_neg": 3, "dim": 8, "buckets": 8,
}


def u(*keys: str) -> str:
    """The hashed uniform of polysem.functions.hashing."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 13))::bigint / 4503599627370496.0)"


def fifth(x: str) -> str:
    return f"(({x} * {x} % 2147483647) * ({x} * {x} % 2147483647) % 2147483647 * {x} % 2147483647)"


def vec_at(v: str) -> str:
    return f"unnest({v}) AS x, generate_subscripts({v}, 1) - 1 AS k"


CLEAN = r"lower(regexp_replace({}, '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g'))"
SOFTPLUS = "(ln(1 + exp(-abs({0}))) + greatest({0}, 0))"


HELD = f"""SELECT doc_id, line FROM sent WHERE {u('42', "'split'", 'doc_id', 'line')}
    < least(0.1::double, 200000.0::double / (SELECT count(*) FROM sent))"""


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def cosine(a: str, b: str) -> str:
    n = f"(sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"
    return f"(CASE WHEN {n} = 0 THEN 0 ELSE {dot(a, b)} / {n} END)"


def doubles(v: str) -> str:
    return f"list_transform({v}, lambda e: e::double)"


def _fit(chunks: int, saved: int) -> str:
    """Rate, sentences and tokens of each iteration of one epoch, and which one is saved."""
    return f"""SELECT c::int AS it, round(0.05 * pow(0.9, c), 9) AS alpha, count(DISTINCT (doc_id, line)) AS n_sentences,
        count(*) AS n_tokens, c = {saved} AS saved
        FROM (SELECT doc_id, line, floor({u('42', "'chunk'", 'doc_id', 'line')} * {chunks}) AS c FROM trained) GROUP BY c"""


PARTS = {
    "sent": r"""SELECT doc_id, (generate_subscripts(a, 1) - 1)::int AS line, unnest(a) AS text
        FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS a FROM documents)""",
    "tok": """SELECT doc_id, line, (generate_subscripts(a, 1) - 1)::int AS raw_pos, unnest(a) AS raw
        FROM (SELECT doc_id, line, string_split(text, ' ') AS a FROM sent)""",
    "w": f"SELECT * FROM (SELECT doc_id, line, raw_pos, {CLEAN.format('raw')} AS word FROM tok) WHERE word <> ''",
    "counts": "SELECT word, count(*) AS cn FROM w GROUP BY word",
    "bench_w": rf"""SELECT item_id, pos, word FROM (
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY p) - 1 AS pos, word FROM (
          SELECT item_id, p, {CLEAN.format('raw')} AS word FROM (
            SELECT item_id, unnest(a) AS raw, generate_subscripts(a, 1) AS p
            FROM (SELECT item_id, string_split(regexp_replace(text, '\r\n|\r|\n', ' ', 'g'), ' ') AS a FROM benchmark)))
        WHERE word <> '')""",
    "evalw": "SELECT DISTINCT word FROM bench_w",
    "kept": f"SELECT * FROM counts WHERE cn >= {P['min_count']} OR word IN (SELECT word FROM evalw)",
    "vocab": f"""SELECT word, cn, (row_number() OVER (ORDER BY cn DESC, word) - 1)::int AS word_id,
        CASE WHEN cn >= 200 THEN 3 WHEN cn >= 50 THEN 2 ELSE 1 END::int AS n_senses
        FROM counts WHERE cn >= {P['min_count']}""",
    "trained": f"""SELECT doc_id, line FROM (SELECT * FROM w ANTI JOIN ({HELD}) USING (doc_id, line)) WHERE word IN (
        SELECT word FROM w ANTI JOIN ({HELD}) USING (doc_id, line) GROUP BY word HAVING count(*) >= {P['min_count']})""",
    "enc": """SELECT doc_id, line, (row_number() OVER (PARTITION BY doc_id, line ORDER BY raw_pos) - 1)::int AS pos,
        word_id, n_senses, word FROM w JOIN vocab USING (word)""",
    "coded": f"""SELECT doc_id, line, pos, word_id, n_senses, word,
        CASE WHEN n_senses > 1 THEN floor({u('42', "'sense'", 'doc_id', 'line', 'pos')} * n_senses) ELSE 0 END::int AS sense
        FROM enc""",
    "cdf": """SELECT word_id, p, hi, coalesce(lag(hi) OVER (ORDER BY word_id), 0) AS lo FROM (
        SELECT word_id, pow(cn, 0.75) / sum(pow(cn, 0.75)) OVER () AS p,
               sum(pow(cn, 0.75)) OVER (ORDER BY word_id) / sum(pow(cn, 0.75)) OVER () AS hi FROM vocab)""",
    "draws": f"""SELECT doc_id, line, pos, word_id, j, CASE WHEN s >= lo THEN s + (hi - lo) ELSE s END AS at FROM (
        SELECT doc_id, line, pos, word_id, j, lo, hi, {fifth('z')} / 2147483647::double * (1 - (hi - lo)) AS s FROM (
          SELECT *, ({fifth('x')} * 48271 + ('0x' || substr(h, 8, 7))::bigint + pos) % 2147483647 AS z FROM (
            SELECT *, (('0x' || substr(h, 1, 7))::bigint + pos::bigint * 1664525 + j::bigint * 1013904223) % 2147483647 AS x FROM (
              SELECT doc_id, line, pos, e.word_id, j, lo, hi, md5(concat_ws('|', 42, 'neg', doc_id, line)) AS h
              FROM enc e JOIN cdf USING (word_id), range({P['n_neg']}) r(j)))))""",
    "negs": "SELECT doc_id, line, pos, j::int AS j, c.word_id AS neg_id FROM draws d ASOF JOIN cdf c ON d.at >= c.lo",
    "senses": "SELECT word_id, unnest(range(n_senses))::int AS sense FROM vocab",
    "model": f"""SELECT mat, word_id, sense, list_transform(range({P['dim']}),
        lambda k: (({u('42', "'init'", 'mat', 'word_id', 'sense', 'k')} - 0.5) * 2)::float) AS vec
        FROM (SELECT 0 AS mat, * FROM senses UNION ALL SELECT 1, word_id, 0 FROM vocab)""",
    "v_in": f"SELECT word_id, sense, {doubles('vec')} AS v FROM model WHERE mat = 0",
    "v_out": f"SELECT word_id, {doubles('vec')} AS v FROM model WHERE mat = 1",
    "pairs": f"""SELECT a.doc_id, a.line, a.pos, b.pos AS ctx_pos, a.word_id, a.sense, a.n_senses, b.word_id AS ctx_id
        FROM coded a JOIN coded b ON a.doc_id = b.doc_id AND a.line = b.line
        AND b.pos BETWEEN a.pos - {P['window']} AND a.pos + {P['window']} AND b.pos <> a.pos""",
    "targets": """SELECT doc_id, line, pos, ctx_pos, word_id, sense, n_senses, ctx_id AS out_id, 1 AS label FROM pairs
        UNION ALL SELECT p.doc_id, p.line, p.pos, ctx_pos, word_id, sense, n_senses, neg_id, 0
        FROM pairs p JOIN negs n ON p.doc_id = n.doc_id AND p.line = n.line AND p.ctx_pos = n.pos""",
    "scored": f"""SELECT t.*, {dot('i.v', 'o.v')} AS x FROM targets t
        JOIN v_in i USING (word_id, sense) JOIN v_out o ON o.word_id = t.out_id""",
    "terms": f"""SELECT doc_id, line, pos, ctx_pos, word_id, sense, label, x,
        CASE WHEN label = 1 THEN {SOFTPLUS.format('(-x)')} ELSE {SOFTPLUS.format('x')} END AS loss FROM scored""",
    "soft": """SELECT doc_id, line, pos, ctx_pos, any_value(word_id) AS word_id, any_value(sense) AS sense,
        ln(sum(exp(x))) AS lse, ln(sum(exp(x))) - sum(label * x) AS loss FROM scored GROUP BY ALL
        """,
    "pairx": f"""SELECT p.word_id, i.sense, p.out_id, {dot('i.v', 'o.v')} AS x
        FROM (SELECT DISTINCT word_id, out_id FROM targets WHERE n_senses > 1) p
        JOIN v_in i USING (word_id) JOIN v_out o ON o.word_id = p.out_id""",
    "cand": f"""SELECT t.doc_id, t.line, t.pos, t.word_id, x.sense,
        sum(CASE WHEN label = 1 THEN {SOFTPLUS.format('(-x.x)')} ELSE {SOFTPLUS.format('x.x')} END) AS loss
        FROM (SELECT * FROM targets WHERE n_senses > 1) t JOIN pairx x USING (word_id, out_id) GROUP BY ALL""",
    "chosen": "SELECT doc_id, line, pos, word_id, arg_min(sense, (loss, sense)) AS sense FROM cand GROUP BY ALL",
    "assigned": """SELECT c.doc_id, c.line, c.pos, c.word_id, c.n_senses, coalesce(s.sense, CASE WHEN c.n_senses > 1 THEN 0 ELSE c.sense END) AS sense,
        c.sense AS old FROM coded c LEFT JOIN chosen s USING (doc_id, line, pos)""",
    "aterms": f"""SELECT t.doc_id, t.line, t.pos, CASE WHEN label = 1 THEN {SOFTPLUS.format('(-' + dot('i.v', 'o.v') + ')')}
            ELSE {SOFTPLUS.format(dot('i.v', 'o.v'))} END AS loss
        FROM targets t JOIN assigned a USING (doc_id, line, pos)
        JOIN v_in i ON i.word_id = a.word_id AND i.sense = a.sense JOIN v_out o ON o.word_id = t.out_id""",
    "slopes": """SELECT word_id, sense, out_id, count(*) * (1 / (1 + exp(-any_value(x))) - label) AS g
        FROM scored GROUP BY word_id, sense, out_id, label""",
    "grad": """SELECT mat, word_id, sense, k, sum(g) AS g FROM (
          SELECT 0 AS mat, s.word_id, s.sense, generate_subscripts(o.v, 1) - 1 AS k, s.g * unnest(o.v) AS g
          FROM slopes s JOIN v_out o ON o.word_id = s.out_id
          UNION ALL
          SELECT 1, s.out_id, 0, generate_subscripts(i.v, 1) - 1, s.g * unnest(i.v) FROM slopes s JOIN v_in i USING (word_id, sense))
        GROUP BY ALL""",
    "sslopes": """SELECT s.word_id, s.sense, s.out_id, sum(exp(x - lse) - label) AS g
        FROM scored s JOIN soft USING (doc_id, line, pos, ctx_pos) GROUP BY s.word_id, s.sense, s.out_id""",
    "sgrad": """SELECT mat, word_id, sense, k, sum(g) AS g FROM (
          SELECT 0 AS mat, s.word_id, s.sense, generate_subscripts(o.v, 1) - 1 AS k, s.g * unnest(o.v) AS g
          FROM sslopes s JOIN v_out o ON o.word_id = s.out_id
          UNION ALL
          SELECT 1, s.out_id, 0, generate_subscripts(i.v, 1) - 1, s.g * unnest(i.v) FROM sslopes s JOIN v_in i USING (word_id, sense))
        GROUP BY ALL""",
    "sense_counts": "SELECT word_id, sense, count(*) AS n FROM assigned GROUP BY ALL",
    "probs": """SELECT word_id, sense, prob * f + coalesce(n, 0) / nw * (1 - f) AS prob FROM (
        SELECT s.word_id, s.sense, 1.0 / v.n_senses::double AS prob, c.n, sum(c.n) OVER (PARTITION BY s.word_id) AS nw,
               exp(sum(c.n) OVER (PARTITION BY s.word_id) * ln(0.99::double)) AS f
        FROM senses s JOIN vocab v USING (word_id) LEFT JOIN sense_counts c USING (word_id, sense))""",
    "shares": """SELECT word_id, sense, prob / sum(prob) OVER (PARTITION BY word_id) AS prob,
        count(*) OVER (PARTITION BY word_id) AS n_senses FROM probs""",
    "donors": """SELECT word_id, sense AS donor, sum(prob) OVER (PARTITION BY word_id ORDER BY sense) AS cum,
        sum(prob) OVER (PARTITION BY word_id) AS mass FROM shares WHERE prob >= 0.2""",
    "plan": f"""SELECT word_id, sense, prob, n_senses, coalesce(donor, sense)::int AS donor, donor IS NOT NULL AS is_reset FROM (
        SELECT s.word_id, s.sense, s.prob, s.n_senses, min(d.donor) AS donor FROM shares s
        LEFT JOIN donors d ON d.word_id = s.word_id AND s.prob < 0.2 AND s.n_senses > 1
             AND d.cum > {u('42', "'donor'", 's.word_id', 's.sense')} * d.mass GROUP BY ALL)""",
    "emb": f"SELECT vec_id, label, 'v' || vec_id AS word, 'v' || vec_id || '_' || label AS key, {doubles('embedding')} AS v FROM embeddings",
    "two": f"SELECT a.vec_id AS id, a.v AS a, b.v AS b FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1",
    "sv": "SELECT v.word, v.word_id, i.sense, v.word || '_' || i.sense AS key, v.n_senses, i.v FROM v_in i JOIN vocab v USING (word_id)",
    "bpairs": """SELECT item_id * 4294967296 + a.pos AS id, a.word AS word1, b.word AS word2
        FROM bench_w a JOIN bench_w b USING (item_id) WHERE b.pos = a.pos + 1""",
    "kpairs": "SELECT * FROM bpairs WHERE word1 IN (SELECT word FROM vocab) AND word2 IN (SELECT word FROM vocab)",
    "psims": f"""SELECT id, word1, word2, avg({cosine('a.v', 'b.v')}) AS avg_sim, greatest(max({cosine('a.v', 'b.v')}), -1) AS max_sim
        FROM kpairs JOIN sv a ON a.word = word1 JOIN sv b ON b.word = word2 GROUP BY ALL""",
    "sqs": "SELECT key, v FROM sv WHERE word IN (SELECT word FROM evalw)",
    "nb": f"""SELECT query, rank::int AS rank, key, sim FROM (
        SELECT q.key AS query, s.key, {cosine('q.v', 's.v')} AS sim,
               row_number() OVER (PARTITION BY q.key ORDER BY {cosine('q.v', 's.v')} DESC, s.key) AS rank
        FROM sqs q, sv s) WHERE rank <= 11""",
    "turns": rf"""SELECT conv_id, turn, list(word ORDER BY p) AS words FROM (
        SELECT conv_id, turn, p, {CLEAN.format('raw')} AS word FROM (
          SELECT conv_id, turn, unnest(a) AS raw, generate_subscripts(a, 1) AS p
          FROM (SELECT conv_id, turn, string_split(regexp_replace(text, '\r\n|\r|\n', ' ', 'g'), ' ') AS a FROM conversations)))
        WHERE word <> '' GROUP BY ALL""",
    "ctx_pairs": """SELECT a.conv_id * 4294967296 + a.turn AS id, a.words[1] AS word1, b.words[1] AS word2,
        array_to_string(a.words, ' ') AS context1, array_to_string(b.words, ' ') AS context2
        FROM turns a JOIN turns b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
    "occ": "SELECT id, 1 AS side, word1 AS word, context1 AS context FROM ctx_pairs UNION ALL SELECT id, 2, word2, context2 FROM ctx_pairs",
    "ctx": "SELECT id, side, o.word, unnest(string_split(context, ' ')) AS c FROM occ o WHERE o.word IN (SELECT word FROM vocab)",
    "ctx_scores": f"""SELECT id, side, word, sense, sum(score) AS score FROM (
        SELECT x.id, x.side, x.word, s.sense, -{SOFTPLUS.format('(-' + dot('s.v', 'o.v') + ')')} AS score
        FROM ctx x JOIN vocab cv ON cv.word = x.c JOIN v_out o ON o.word_id = cv.word_id JOIN sv s ON s.word = x.word
        UNION ALL SELECT o.id, o.side, o.word, s.sense, 0 FROM occ o JOIN sv s ON s.word = o.word) GROUP BY ALL""",
    "picked": "SELECT id, side, word, arg_max(sense, (score, -sense)) AS sense FROM ctx_scores GROUP BY ALL",
    "hist": """SELECT (row_number() OVER (ORDER BY day) - 1)::int AS it, loss FROM (
        SELECT ts::date AS day, avg(value) AS loss FROM events GROUP BY day)""",
    "cosines": f"SELECT a.vec_id AS i, b.vec_id AS j, {cosine('a.v', 'b.v')} AS c FROM emb a JOIN emb b ON a.vec_id <> b.vec_id",
    "aff": "SELECT i, j, greatest(c, 0) / sum(greatest(c, 0)) OVER () AS p FROM cosines",
    "coords": f"""SELECT vec_id AS i, list_transform(range(2), lambda k: sqrt(-2 * ln(1 - {u('42', "'y1'", 'vec_id', 'k')}))
        * cos(2 * pi() * {u('42', "'y2'", 'vec_id', 'k')})) AS y FROM embeddings""",
    "nums": """SELECT a.i, b.i AS j, a.y AS yi, b.y AS yj,
        1 / (1 + pow(a.y[1] - b.y[1], 2) + pow(a.y[2] - b.y[2], 2)) AS num FROM coords a JOIN coords b ON a.i <> b.i""",
    "tq": "SELECT *, greatest(num / sum(num) OVER (), 1e-100) AS q FROM nums",
    "tgrad": """SELECT i, [4 * sum((greatest(p, 1e-100) - q) * num * (yi[1] - yj[1])),
                           4 * sum((greatest(p, 1e-100) - q) * num * (yi[2] - yj[2]))] AS g
        FROM tq JOIN aff USING (i, j) GROUP BY i""",
    "inc": f"SELECT vec_id AS i, list_transform(range(2), lambda k: {u('42', "'inc'", 'vec_id', 'k')} - 0.5) AS inc FROM embeddings",
}


def sql(select: str) -> str:
    """Put the parts a SELECT names, and the parts those name, in front."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN|,)\s+([a-z_]+)\b", text):
            if name in PARTS and name not in order:
                visit(PARTS[name])
                if name not in order:
                    order.append(name)

    select = select.replace("round(", "0 + round(")  # minus zero becomes zero
    visit(select)
    if not order:
        return select
    parts = ",\n".join(f"{name} AS ({PARTS[name]})" for name in order)
    return f"WITH {parts}\n{select}"


def _dims(source: str, keys: str, vec: str = "v", digits: int = 6) -> str:
    return f"SELECT {keys}, (k)::int AS k, round(x, {digits}) AS x FROM (SELECT {keys}, {vec_at(vec)} FROM {source})"


QUERIES: dict[str, str] = {
    # sources
    "scan_sentences": "SELECT doc_id, line, text FROM sent",
    "corpus_preview": "SELECT doc_id, line, text, (SELECT count(*) FROM sent) AS n_lines FROM sent ORDER BY doc_id, line LIMIT 2",
    "scan_eval_words": "SELECT word FROM evalw",
    "scan_sense_vectors": """SELECT word, sense::int AS sense, (sense + 1)::int AS n_senses, k::int AS k, round(x, 6) AS x
        FROM (SELECT word, label AS sense, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS k FROM emb)""",
    "scan_word_pairs": """SELECT f[1] AS word1, f[2] AS word2, count(*) AS n
        FROM (SELECT string_split(word1 || ',' || word2 || ',' || id, ',') AS f FROM bpairs) GROUP BY ALL""",
    "scan_context_pairs": r"""SELECT f[1] AS word1, f[2] AS word2, f[3] AS context1, f[4] AS context2, count(*) AS n FROM (
        SELECT string_split(word1 || chr(9) || word2 || chr(9) || context1 || chr(9) || context2, chr(9)) AS f FROM ctx_pairs)
        GROUP BY ALL""",
    "scan_series": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, n_chars::double AS x FROM documents",
    # sinks
    "write_word_index": "SELECT word || '_' || word_id || '_' || n_senses AS value FROM vocab",
    "write_sense_vectors": _dims("sv", "word, sense"),
    "write_w2v_text": f"""SELECT key, k::int AS k, round(x, 6) AS x FROM (
        SELECT key, {vec_at('v')} FROM sv UNION ALL SELECT count(*)::varchar, {P['dim']}::double, 0 FROM sv)""",
    "write_flat_model": f"""SELECT key, idx, k::int AS k, round(x, 6) AS x FROM (SELECT key, idx, {vec_at('v')} FROM (
        SELECT key, v, row_number() OVER (ORDER BY word, sense) - 1 AS idx FROM sv))""",
    "write_history": """SELECT it, CASE WHEN it % 2 = 1 THEN round(loss, 6) ELSE 0 END AS vali_loss, 0.0::double AS vali_adjust FROM hist""",
    "write_tagged_corpus": "SELECT string_agg(word || '_' || sense, ' ' ORDER BY pos) AS value FROM coded GROUP BY doc_id, line",
    "write_neighbor_lists": "SELECT DISTINCT regexp_extract(query, '^(.*)_[0-9]+$', 1) AS query_word, key AS value FROM nb",
    "write_scores": "SELECT id, round(avg_sim, 6) AS score FROM psims",
    # text
    "tokenize": "SELECT doc_id, line, raw_pos, raw FROM tok",
    "clean_tokens": "SELECT doc_id, line, raw_pos, word FROM w",
    "filter_oov": "SELECT doc_id, line, pos, word_id FROM enc",
    "drop_empty_sentences": "SELECT doc_id, line, count(*) AS n_tokens FROM enc GROUP BY ALL",
    "encode_word_sense": "SELECT doc_id, line, pos, word_id::bigint * 100 + sense AS code FROM coded",
    "decode_word_sense": """SELECT word_id::bigint * 100 + sense AS code, word_id, sense, word_id::bigint * 100 AS first_code,
        count(*) AS n FROM coded GROUP BY ALL""",
    "vocab_predicate": "SELECT word, cn FROM kept",
    "parse_search_term": """SELECT word AS term, word, sense FROM sv UNION ALL SELECT key, word, sense FROM sv""",
    # sampling
    "train_validation_split": f"""SELECT doc_id, line, {u('42', "'split'", 'doc_id', 'line')}
        < least(0.1::double, 200000.0::double / (SELECT count(*) FROM sent)) AS is_validation FROM sent""",
    "chunk_split": f"SELECT doc_id, line, floor({u('42', "'chunk'", 'doc_id', 'line')} * 20)::int AS chunk FROM sent",
    "init_senses": "SELECT doc_id, line, pos, word_id, sense FROM coded",
    "unigram_distribution": "SELECT word_id, round(p, 9) AS p, round(hi, 9) AS hi FROM cdf",
    "negative_samples": "SELECT doc_id, line, pos, string_agg(neg_id, ' ' ORDER BY j) AS neg_ids FROM negs GROUP BY ALL",
    "negative_sense": f"""SELECT neg_id AS word_id, floor({u('42', "'negsense'", 'doc_id', 'line', 'pos', 'j')} * n_senses)::int AS sense,
        count(*) AS n FROM negs JOIN vocab ON neg_id = word_id GROUP BY ALL""",
    "categorical_sample": f"""SELECT user_id, min(event_type) AS event_type FROM (
        SELECT user_id, event_type, sum(n) OVER (PARTITION BY user_id ORDER BY event_type) AS cum, sum(n) OVER (PARTITION BY user_id) AS total
        FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL))
        WHERE cum > {u('42', "'category'", 'user_id')} * total GROUP BY user_id""",
    "vocab_sample": f"""SELECT word, word_id, cn, n_senses FROM vocab
        WHERE {u('42', "'vocab'", 'word_id')} < 50 / (SELECT count(*) FROM vocab)::double""",
    # aggregations
    "word_count": "SELECT word, cn FROM counts",
    "count_of_counts": "SELECT cn, count(*) AS n_words FROM counts GROUP BY cn",
    "accumulated_count_histogram": """SELECT cn, n_words, (sum(n_words) OVER (ORDER BY cn DESC))::bigint AS n_at_least
        FROM (SELECT cn, count(*) AS n_words FROM counts GROUP BY cn)""",
    "build_vocab": "SELECT word, cn, (row_number() OVER (ORDER BY cn DESC, word) - 1)::int AS word_id FROM kept",
    "vocab_totals": """SELECT (SELECT count(*) FROM counts) AS raw_words, count(*) AS vocab_words, sum(cn)::bigint AS running_tokens FROM vocab""",
    "senses_per_word": "SELECT word, cn, n_senses FROM vocab",
    "sense_count_histogram": "SELECT n_senses, count(*) AS n_words FROM vocab GROUP BY n_senses",
    "parameter_count": """SELECT sum(n_senses)::bigint AS n_rows, (sum(n_senses) * 8)::bigint AS per_matrix,
        (sum(n_senses) * 16)::bigint AS in_total FROM vocab""",
    "token_sense_counts": "SELECT word_id, sense, n FROM sense_counts",
    "adjust_rate": """SELECT round(avg(a), 6) AS adjust_rate, count(*) AS n_sentences
        FROM (SELECT max((sense <> old)::int) AS a FROM assigned GROUP BY doc_id, line)""",
    "loss_per_prediction": "SELECT round(sum(loss) / count(*), 6) AS loss_per_prediction, count(*) AS n_pred FROM terms",
    "average_parameters": f"""SELECT m.mat, m.word_id, m.sense, m.k::int AS k, round(m.x + coalesce(g.g, 0) / {P['buckets']}, 4) AS x
        FROM (SELECT mat, word_id, sense, {vec_at(doubles('vec'))} FROM model) m LEFT JOIN grad g USING (mat, word_id, sense, k)""",
    # joins
    "join_vocab": "SELECT doc_id, line, pos, word_id FROM enc",
    "join_eval_words": "SELECT word, cn FROM counts WHERE word IN (SELECT word FROM evalw)",
    "skipgram_pairs": "SELECT word_id, ctx_id, count(*) AS n_pairs, sum(abs(pos - ctx_pos))::bigint AS distance FROM pairs GROUP BY ALL",
    "expand_senses": "SELECT word_id, s.sense, count(*) AS n_tokens FROM enc JOIN senses s USING (word_id) GROUP BY ALL",
    "lookup_embeddings": """SELECT mat, code, n, k::int AS k, round(x, 6) AS x FROM (
        SELECT 0 AS mat, word_id::bigint * 100 + sense AS code, n, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS k
        FROM (SELECT word_id, sense, count(*) AS n FROM coded GROUP BY ALL) JOIN v_in USING (word_id, sense)
        UNION ALL
        SELECT 1, word_id::bigint * 100, n, unnest(v), generate_subscripts(v, 1) - 1
        FROM (SELECT word_id, count(*) AS n FROM coded GROUP BY ALL) JOIN v_out USING (word_id))""",
    "cross_similarity": f"""SELECT q.key AS query, s.key, round({cosine('q.v', 's.v')}, 6) AS sim
        FROM (SELECT arg_min(key, vec_id) AS key, arg_min(v, vec_id) AS v FROM emb GROUP BY label) q, emb s""",
    "zip_series": """SELECT a.idx, x, y FROM
        (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, n_chars::double AS x FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) a
        JOIN (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, quality::double AS y FROM labels) b USING (idx)""",
    # windows
    "context_window": """SELECT doc_id, line, pos, word_id, string_agg(ctx_id, ' ' ORDER BY ctx_pos) AS context FROM (
        SELECT c.doc_id, c.line, c.pos, c.word_id, ctx_id, ctx_pos FROM coded c LEFT JOIN pairs p USING (doc_id, line, pos)) GROUP BY ALL""",
    "sort_word_index": "SELECT word_id, word FROM vocab ORDER BY word_id",
    "top_k_neighbors": f"""SELECT query, rank::int AS rank, key, round(sim, 6) AS sim FROM (
        SELECT q.key AS query, s.key, {cosine('q.v', 's.v')} AS sim,
               row_number() OVER (PARTITION BY q.key ORDER BY {cosine('q.v', 's.v')} DESC, s.key) AS rank
        FROM emb q, emb s) WHERE rank <= 11""",
    "distinct_neighbors": "SELECT DISTINCT key FROM nb",
    # vector expressions
    "vec_dot": f"SELECT id, round({dot('a', 'b')}, 6) AS value FROM two",
    "vec_norm": f"SELECT vec_id AS id, round(sqrt({dot('v', 'v')}), 6) AS value FROM emb",
    "vec_distance": "SELECT id, round(list_distance(a, b), 6) AS value FROM two",
    "vec_cosine": f"SELECT id, round({cosine('a', 'b')}, 6) AS value FROM two",
    "vec_angle": f"SELECT id, round(acos(greatest(-1, least(1, {cosine('a', 'b')}))), 6) AS value FROM two",
    "vec_normalize": _dims(f"(SELECT vec_id AS id, list_transform(v, lambda e: e / sqrt({dot('v', 'v')})) AS v FROM emb)", "id"),
    "vec_limit_length": _dims(
        f"""(SELECT id, CASE WHEN n > 2.5 THEN list_transform(v, lambda e: e * 2.5 / n) ELSE v END AS v FROM (
            SELECT id, v, sqrt({dot('v', 'v')}) AS n FROM (
              SELECT vec_id AS id, list_transform(v, lambda e: e * (1 + vec_id % 5)) AS v FROM emb)))""", "id"),
    "vec_set_length": _dims(f"(SELECT vec_id AS id, list_transform(v, lambda e: e * 3.0 / sqrt({dot('v', 'v')})) AS v FROM emb)", "id"),
    "vec_between": """SELECT id, k::int AS k, round(x + (y - x) * 0.25, 6) AS x FROM (
        SELECT id, unnest(a) AS x, unnest(b) AS y, generate_subscripts(a, 1) - 1 AS k FROM two)""",
    "vec_elementwise": """SELECT id, k::int AS k, round(x + y, 6) AS plus, round(x - y, 6) AS minus, round(x * y, 6) AS times,
        round(x * 2.5, 6) AS scaled FROM (SELECT id, unnest(a) AS x, unnest(b) AS y, generate_subscripts(a, 1) - 1 AS k FROM two)""",
    "sigmoid": f"SELECT id, round(1 / (1 + exp(-10 * {dot('a', 'b')})), 6) AS value FROM two",
    "log_softmax": f"""SELECT id, round(d - lse, 6) AS log_p, round(exp(d - lse) - 1, 6) AS dx, k::int AS k, round(exp(x - lse), 6) AS dy FROM (
        SELECT id, d, lse, unnest(a) AS x, generate_subscripts(a, 1) - 1 AS k FROM (
          SELECT id, a, {dot('a', 'b')} AS d, ln(exp({dot('a', 'b')}) + list_sum(list_transform(a, lambda e: exp(e)))) AS lse FROM two))""",
    # vector tables
    "vector_sum": """SELECT label, k::int AS k, round(sum(x), 6) AS x FROM (
        SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS k FROM emb) GROUP BY label, k""",
    "vector_mean": """SELECT label, k::int AS k, round(avg(x), 6) AS x FROM (
        SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS k FROM emb) GROUP BY label, k""",
    "center_vectors": """SELECT vec_id AS id, k::int AS k, round(x - avg(x) OVER (PARTITION BY k), 6) AS x FROM (
        SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS k FROM emb)""",
    "pairwise_cosine": "SELECT i, j, round(c, 6) AS value FROM cosines UNION ALL SELECT vec_id, vec_id, 0 FROM emb",
    "gram_matrix": f"SELECT a.vec_id AS i, b.vec_id AS j, round({dot('a.v', 'b.v')}, 6) AS value FROM emb a, emb b",
    # model
    "init_random": f"""SELECT mat, word_id, sense, k::int AS k, round((({u('42', "'init'", 'mat', 'word_id', 'sense', 'k')} - 0.5)
        * (CASE mat WHEN 0 THEN 1.0 ELSE 0.5 END / 8)::double)::float::double, 7) AS x
        FROM (SELECT 0 AS mat, * FROM senses UNION ALL SELECT 1, word_id, 0 FROM vocab), range(8) r(k)""",
    "init_zero": "SELECT mat, word_id, sense, 8 AS width, 0.0::double AS total FROM model",
    "init_from_model": f"""SELECT word_id, sense, k::int AS k, round(CASE WHEN word_id % 3 = 2 THEN 0
          WHEN sense = 1 THEN x ELSE f + ({u('42', "'warm0'", 'word_id', 'sense', 'k')} - 0.5) * 0.01::double / 8 END::float::double, 6) AS x FROM (
        SELECT i.word_id, i.sense, unnest(i.v) AS x, unnest(f.v) AS f, generate_subscripts(i.v, 1) - 1 AS k
        FROM v_in i JOIN v_in f ON f.word_id = i.word_id AND f.sense = 0)""",
    # objective
    "sgns_pair_loss": """SELECT word_id, sense, count(*) AS n_pairs, sum(n)::bigint AS n_pred, round(sum(loss), 4) AS loss, round(max(loss), 6) AS worst
        FROM (SELECT doc_id, line, pos, ctx_pos, any_value(word_id) AS word_id, any_value(sense) AS sense, count(*) AS n, sum(loss) AS loss
        FROM terms GROUP BY doc_id, line, pos, ctx_pos) GROUP BY word_id, sense""",
    "softmax_pair_loss": """SELECT word_id, sense, count(*) AS n_pairs, round(sum(loss), 4) AS loss, round(max(loss), 6) AS worst
        FROM soft GROUP BY word_id, sense""",
    "sentence_loss": """SELECT doc_id, line, round(coalesce(loss, 0), 4) AS loss, coalesce(n_pred, 0) AS n_pred
        FROM (SELECT DISTINCT doc_id, line FROM enc) LEFT JOIN
        (SELECT doc_id, line, sum(loss) AS loss, count(*) AS n_pred FROM terms GROUP BY doc_id, line) USING (doc_id, line)""",
    "assign_senses": "SELECT doc_id, line, pos, word_id, sense FROM assigned WHERE n_senses > 1",
    "sgns_gradient": "SELECT mat, word_id, sense, k::int AS k, round(g, 4) AS g FROM grad",
    "softmax_gradient": "SELECT mat, word_id, sense, k::int AS k, round(g, 4) AS g FROM sgrad",
    "weight_decay": f"""SELECT mat, word_id, sense, k::int AS k, round(x * (1 - 0.1 * share), 6) AS x FROM (
        SELECT mat, word_id, sense, {vec_at(doubles('vec'))} FROM model), (
        SELECT avg((floor({u('42', "'chunk'", 'doc_id', 'line')} * 20) = 0)::int) AS share FROM sent)""",
    "limit_norm": f"""SELECT mat, word_id, sense, n > 2.5 AS limited, k::int AS k, round(CASE WHEN n > 2.5 THEN x * sqrt(0.99 * 2.5 / n) ELSE x END, 6) AS x
        FROM (SELECT mat, word_id, sense, {dot(doubles('vec'), doubles('vec'))} AS n, {vec_at(doubles('vec'))} FROM model)""",
    "update_sense_probs": "SELECT word_id, sense, round(prob, 6) AS prob FROM probs",
    "reset_rare_senses": f"""SELECT p.word_id, p.sense, p.donor, p.is_reset, k::int AS k, round(x, 6) AS x FROM plan p JOIN (
        SELECT p.word_id, p.sense, generate_subscripts(i.v, 1) - 1 AS k,
          CASE WHEN is_reset THEN (unnest(i.v) + ({u('42', "'reset'", '0', 'p.word_id', 'p.sense', '(generate_subscripts(i.v, 1) - 1)')} - 0.5) * 0.01::double / 8)::float::double
          ELSE unnest(i.v) END AS x
        FROM plan p JOIN v_in i ON i.word_id = p.word_id AND i.sense = p.donor) USING (word_id, sense)""",
    "learning_rate_schedule": "SELECT it, round(greatest(0.1 * pow(0.9::double, it), 1e-4 * 0.1), 9) AS alpha FROM hist",
    "validate_model": f"""SELECT loss_per_prediction, n_pred, adjust_rate FROM
        (SELECT round(sum(loss) / count(*), 6) AS loss_per_prediction, count(*) AS n_pred FROM aterms JOIN ({HELD}) USING (doc_id, line)),
        (SELECT round(avg(a), 6) AS adjust_rate FROM (SELECT max((sense <> old)::int) AS a FROM assigned
            JOIN ({HELD}) USING (doc_id, line) GROUP BY doc_id, line))""",
    "fit_one_sense": _fit(2, 1),
    "fit_multi_sense": _fit(2, 1),
    "resume_fit": _fit(1, 0),
    "early_stop": """SELECT it, round(loss, 6) AS vali_loss, it < coalesce(stop, it + 1) AS is_saved FROM hist,
        (SELECT min(it) AS stop FROM (SELECT it, loss > lag(loss) OVER (ORDER BY it) AS up FROM hist) WHERE up)
        WHERE it <= coalesce(stop, it)""",
    # queries on vectors
    "get_vector": _dims("sqs", "key"),
    "sense_similarity_matrix": f"""SELECT a.word, a.sense AS sense_a, b.sense AS sense_b, round({cosine('a.v', 'b.v')}, 6) AS sim
        FROM sv a JOIN sv b USING (word)""",
    "neighbors_report": f"""SELECT q.word AS term, 'neighbor' AS part, CASE WHEN q.n_senses = 1 THEN q.word ELSE q.key END AS query, rank,
          CASE WHEN s.n_senses = 1 THEN s.word ELSE s.key END AS other, round(sim, 6) AS sim
        FROM nb JOIN sv q ON q.key = nb.query JOIN sv s ON s.key = nb.key
        UNION ALL SELECT a.word, 'senses', a.key, b.sense, b.key, round({cosine('a.v', 'b.v')}, 6)
        FROM sv a JOIN sv b USING (word) WHERE a.n_senses > 1 AND a.word IN (SELECT word FROM evalw)""",
    "avg_sim": "SELECT id, word1, word2, round(avg_sim, 6) AS score FROM psims",
    "max_sim": "SELECT id, word1, word2, round(max_sim, 6) AS score FROM psims",
    "pair_similarity_job": "SELECT id, word1, word2, round(avg_sim, 6) AS score FROM psims",
    "disambiguate_in_context": "SELECT id, side, word, sense FROM picked",
    "contextual_similarity": f"""SELECT a.id, a.word AS word1, a.sense AS sense1, b.word AS word2, b.sense AS sense2,
        round(10 * {cosine('x.v', 'y.v')}, 6) AS score FROM picked a JOIN picked b ON a.id = b.id AND a.side = 1 AND b.side = 2
        JOIN sv x ON x.word = a.word AND x.sense = a.sense JOIN sv y ON y.word = b.word AND y.sense = b.sense""",
    "pearson_correlation": """SELECT round(corr(n_chars::double, quality::double), 6) AS r FROM documents JOIN labels USING (doc_id)""",
    "evaluate_similarity": "SELECT round(corr(avg_sim, abs(length(word1) - length(word2))::double), 6) AS r, count(*) AS n_pairs FROM psims",
    # map
    "tsne_affinity": "SELECT i, j, round(greatest(p, 1e-100), 9) AS p FROM aff",
    "tsne_similarity": "SELECT i, j, round(num, 6) AS num, round(q, 9) AS q FROM tq",
    "tsne_gradient": "SELECT i, k::int AS k, round(x, 9) AS g FROM (SELECT i, unnest(g) AS x, generate_subscripts(g, 1) - 1 AS k FROM tgrad)",
    "tsne_update": """SELECT i, k::int AS k, round(y - avg(y) OVER (PARTITION BY k), 6) AS y, round(inc, 6) AS inc, gain FROM (
        SELECT i, k, gain, 0.5 * inc - 500 * gain * g AS inc, y + 0.5 * inc - 500 * gain * g AS y FROM (
          SELECT i, k, y, inc, g, CASE WHEN sign(g) <> sign(inc) THEN 1.2 ELSE 0.8 END::double AS gain FROM (
            SELECT i, unnest(y) AS y, unnest(inc) AS inc, unnest(g) AS g, generate_subscripts(y, 1) - 1 AS k
            FROM tgrad JOIN inc USING (i) JOIN coords USING (i))))""",
}


def oracle_sql() -> dict[str, str]:
    return {name: sql(select) for name, select in QUERIES.items()}
