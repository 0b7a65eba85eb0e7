"""Queries of fill-in-the-middle, packing, conversations, problems and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.numbers import ramp
from textmill.functions.text import uniform, words
from textmill.operators import budget, chunk, fim, pack, rl, sft
from textmill.operators.filters import is_python
from textmill.plans import manifest
from textmill.plans.ordered import running_sum
from textmill.queries.base import SHARD_TOKENS, SQL, SQL_DOCS, SQL_TAKEN, SQL_TARGETS, SQL_WORDS, counted, docs, mix, query, read, sources, sql_uniform
from textmill.sources.mix import targets

_FIM = fim.Fim(most=0.9, ramp_tokens=100_000, end_fraction=0.2)
_U = lambda name: sql_uniform("'42'", "source_id", "seq", f"'{name}'")
_POSITION = "coalesce(sum(n_tokens + 1) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@query(f"WITH {SQL_DOCS} SELECT seq, CAST({_POSITION} AS BIGINT) AS position, round(0.9::DOUBLE * sin(pi() / 2 * least({_POSITION} / 100000.0::DOUBLE, 1.0)), 6) AS probability FROM docs")
def fim_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = running_sum(counted(spark, sf_dir), [], "seq", F.col("n_tokens") + 1, "position")
    return p.select("seq", F.col("position").cast("long").alias("position"), F.round(ramp(F.col("position"), 0.0, 0.9, 100_000), 6).alias("probability"))


_T = "tokens"


@query(
    f"""WITH {SQL_DOCS}, p AS (SELECT source_id, seq, category, {SQL_WORDS} AS tokens, n_tokens AS n, {_POSITION} AS position FROM docs),
    q AS (SELECT p.*, 1 + CAST(floor({_U("cut-1")} * (n - 1)) AS BIGINT) AS c1, 1 + CAST(floor({_U("cut-2")} * (n - 2)) AS BIGINT) AS c2, 4 + CAST(floor({_U("end-cut")} * (n - 7)) AS BIGINT) AS e,
      CASE WHEN category NOT IN ('python_code', 'other_code') OR n < 8 OR {_U("coin")} >= 0.9::DOUBLE * sin(pi() / 2 * least(position / 100000.0::DOUBLE, 1.0)) THEN 'standard'
      WHEN {_U("end")} < 0.2 THEN 'end' WHEN {_U("psm")} < 0.5 THEN 'psm' ELSE 'spm' END AS kind FROM p),
    r AS (SELECT q.*, least(c1, CASE WHEN c2 >= c1 THEN c2 + 1 ELSE c2 END) AS a, greatest(c1, CASE WHEN c2 >= c1 THEN c2 + 1 ELSE c2 END) AS b FROM q)
    SELECT seq, CASE kind WHEN 'standard' THEN 'standard' WHEN 'spm' THEN 'fim_spm' ELSE 'fim_psm' END AS mode, md5(array_to_string(CASE kind
      WHEN 'end' THEN ['<fim_prefix>'] || {_T}[:e] || ['<fim_suffix>', '<fim_middle>'] || {_T}[e + 1:]
      WHEN 'psm' THEN ['<fim_prefix>'] || {_T}[:a] || ['<fim_suffix>'] || {_T}[b + 1:] || ['<fim_middle>'] || {_T}[a + 1:b]
      WHEN 'spm' THEN ['<fim_suffix>'] || {_T}[b + 1:] || ['<fim_prefix>'] || {_T}[:a] || ['<fim_middle>'] || {_T}[a + 1:b] ELSE {_T} END, ' ')) AS turned FROM r"""
)
def fim_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).withColumn("tokens", words("text")).drop("text")
    p = running_sum(d, [], "seq", F.size("tokens").cast("long") + 1, "position")
    return fim.transform(p, _FIM).select("seq", "mode", F.md5(F.array_join("tokens", " ").cast("binary")).alias("turned"))


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python modules made of the documents' first words, with the whole text as a docstring."""
    d = docs(spark, sf_dir).filter("category = 'python_code'")
    w = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    name = lambda i: F.concat(F.lit("f_"), F.coalesce(F.get(w, F.lit(i)), F.lit("x")))
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\"\\\n]", " ")
    parts = [F.lit("import os\nfrom sys import path\n\n\ndef "), name(0), F.lit('(a, b=1):\n    """'), said, F.lit('"""\n    total = a + b\n    return total * 2\n\n\nclass C:\n    """Holds."""\n\n    @property\n    def '), name(1), F.lit('(self):\n        """Gives."""\n        return self.value + 1000\n')]
    broken = F.when(F.col("seq") % 3 == 0, "def broken(:\n").otherwise("")
    return d.select("source_id", "seq", "category", F.lit("m.py").alias("path"), F.concat(*parts, broken).alias("text"))


_PARTS = f"""parts AS (SELECT source_id, seq, category, 'import os' || chr(10) || 'from sys import path' || repeat(chr(10), 3) || 'def f_' || coalesce(lower(regexp_extract_all(text, '[A-Za-z]+')[1]), 'x') || '(a, b=1):' || chr(10) || '    \"\"\"' || regexp_replace(coalesce(text, ''), '["\\\\\\n]', ' ', 'g') || '\"\"\"' AS one,
  chr(10) || '    total = a + b' || chr(10) || '    return total * 2' || repeat(chr(10), 3) || 'class C:' || chr(10) || '    \"\"\"Holds.\"\"\"' || repeat(chr(10), 2) || '    @property' || chr(10) || '    def f_' || coalesce(lower(regexp_extract_all(text, '[A-Za-z]+')[2]), 'x') || '(self):' || chr(10) || '        \"\"\"Gives.\"\"\"' AS two,
  chr(10) || '        return self.value + 1000' || chr(10) || CASE WHEN seq % 3 = 0 THEN 'def broken(:' || chr(10) ELSE '' END AS three FROM docs WHERE category = 'python_code')"""


@query(f"WITH {SQL_DOCS}, {_PARTS} SELECT seq, CASE WHEN {sql_uniform("'42'", 'seq', "'docstring'")} < 0.5 THEN one ELSE one || two END AS prompt, CASE WHEN {sql_uniform("'42'", 'seq', "'docstring'")} < 0.5 THEN two || three ELSE three END AS rest FROM parts")
def fim_docstring(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _code(spark, sf_dir).withColumn("x", fim.split_at_docstring(F.col("text"), uniform("42", F.col("seq"), "docstring")))
    return c.select("seq", "x.prompt", "x.rest").filter("rest <> ''")


_FULL = fim.Fim(most=1.0, ramp_tokens=1, docstring_fraction=0.5, filename_probability=0.5, end_fraction=1.0)
_CODE_WORDS = lambda x: rf"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"


@query(
    f"WITH {SQL_DOCS}, {_PARTS}, named AS (SELECT *, CASE WHEN {_U('filename')} < 0.5 THEN ['<filename>', 'm.py'] ELSE [] END || {_CODE_WORDS('one || two || three')} AS tokens, CASE WHEN {_U('docstring-filename')} < 0.5 THEN ['<filename>', 'm.py'] ELSE [] END AS head, {_U('docstring-match')} < 0.5 AS first, {_U('docstring')} < 0.5 AS cut FROM parts)"
    f" SELECT seq, 'fim_psm' AS mode, md5(array_to_string(CASE WHEN cut THEN ['<fim_prefix>'] || head || {_CODE_WORDS('CASE WHEN first THEN one ELSE one || two END')} || ['<fim_suffix>', '<fim_middle>'] || {_CODE_WORDS('CASE WHEN first THEN two || three ELSE three END')}"
    f" ELSE ['<fim_prefix>'] || tokens[:4 + CAST(floor({_U('end-cut')} * (len(tokens) - 7)) AS BIGINT)] || ['<fim_suffix>', '<fim_middle>'] || tokens[5 + CAST(floor({_U('end-cut')} * (len(tokens) - 7)) AS BIGINT):] END || ['<eos>'], ' ')) AS turned FROM named"
)
def fim_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of files, cuts after docstrings and end tokens in the one transform; the draws that are left complete the end."""
    c = _code(spark, sf_dir).withColumns({"tokens": words("text"), "position": F.lit(10**9).cast("long")})
    out = fim.transform(c, _FULL, encode=words, path="path", end="<eos>")
    return out.select("seq", "mode", F.md5(F.array_join("tokens", " ").cast("binary")).alias("turned"))


_CHUNKS = f"""{_PARTS}, c AS (SELECT seq, one || two || three AS whole, {sql_uniform("'42'", 'seq', "'chunk'")} < 0.8 AND seq % 3 <> 0 AND length(one || two || three) <= 200000 AS parsed,
  'import os' || chr(10) || 'from sys import path' || repeat(chr(10), 2) || substr(one, 34) || chr(10) || '    total = a + b' || chr(10) || '    return total * 2' || chr(10) AS f,
  'import os' || chr(10) || 'from sys import path' || repeat(chr(10), 2) || 'class C:' || chr(10) || '    \"\"\"Holds.\"\"\"' || chr(10) || substr(two, strpos(two, '    @property')) || chr(10) || '        return self.value + 1000' || chr(10) AS m FROM parts)"""


@query(
    f"WITH {SQL_DOCS}, {_CHUNKS} SELECT seq, 0 AS chunk_no, NULL AS chunk_type, whole AS text FROM c WHERE NOT parsed UNION ALL SELECT seq, 0, 'python_function', f FROM c WHERE parsed AND length(f) <= 24001"
    " UNION ALL SELECT seq, CASE WHEN length(f) <= 24001 THEN 1 ELSE 0 END, 'python_method', m FROM c WHERE parsed"
)
def ast_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _code(spark, sf_dir)
    return chunk.chunked(c, chunk.Chunking(split_probability=0.8), eligible=is_python(F.col("category"), F.col("path"))).select("seq", "chunk_no", "chunk_type", "text")


@query(
    f"SELECT page_id, CASE WHEN url <> '' AND {sql_uniform("'42'", 'page_id', "'filename'")} < 0.5 THEN ['<filename>', url] ELSE [] END || ['body'] AS tokens FROM pages"
)
def filename_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", fim.with_filename(F.array(F.lit("body")), F.col("url"), F.array("url"), uniform("42", F.col("page_id"), "filename"), _FIM).alias("tokens"))


_SPANS = f"spans AS (SELECT source_id, seq, w, t - 1 AS place, row_number() OVER (PARTITION BY source_id ORDER BY seq, t) - 1 AS nth FROM (SELECT source_id, seq, unnest({SQL_WORDS}) AS w, generate_subscripts({SQL_WORDS}, 1) AS t FROM docs))"
_WINDOWS = "windows AS (SELECT source_id, nth // 513 AS \"window\", list(w ORDER BY nth) AS ids, list(place ORDER BY nth) AS positions FROM spans GROUP BY ALL HAVING count(*) = 513)"


@query(f"WITH {SQL_DOCS}, {_SPANS}, {_WINDOWS} SELECT source_id, \"window\", md5(array_to_string(ids, ' ')) AS ids, md5(array_to_string(positions, ' ')) AS positions FROM windows")
def pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("source_id", "seq", words("text").alias("tokens"))
    return pack.windows(d, 513, key="source_id", order="seq").select("source_id", "window", F.md5(F.array_join("input_ids", " ").cast("binary")).alias("ids"), F.md5(F.array_join(F.col("positions").cast("array<string>"), " ").cast("binary")).alias("positions"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("source_id", "seq", words("text").alias("tokens"))
    return pack.windows(d, 513, key="source_id", order="seq")


@query(
    f"WITH {SQL_DOCS}, {_SPANS}, {_WINDOWS} SELECT source_id, \"window\", CAST(len(list_filter(positions, lambda p: p = 0)) AS INT) AS begun, CAST(len(list_filter(positions[2:], lambda p: p <> 0)) AS INT) AS counted, md5(array_to_string(ids[:512], ' ')) AS x, md5(array_to_string(ids[2:], ' ')) AS y FROM windows"
)
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as training samples: segments begun, positions that count for the loss, inputs and targets."""
    w = _windows(spark, sf_dir)
    x, y = pack.shift(F.col("input_ids"))
    digest = lambda a: F.md5(F.array_join(a, " ").cast("binary"))
    begun = F.size(F.filter("positions", lambda p: p == 0))
    return w.select("source_id", "window", begun.alias("begun"), F.size(F.filter(pack.loss_mask(F.col("positions")), lambda m: m)).alias("counted"), digest(x).alias("x"), digest(y).alias("y"))


@query(
    f"WITH {SQL_DOCS}, {_SPANS}, tok AS (SELECT source_id, nth // 32 AS \"window\", nth % 32 AS p, place FROM spans), seg AS (SELECT *, CAST(sum(CASE WHEN place = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, \"window\" ORDER BY p) AS BIGINT) AS segment FROM tok)"
    " SELECT source_id, \"window\", count(DISTINCT segment) AS segments, CAST(sum((n * (n + 1)) // 2) AS BIGINT) AS pairs FROM (SELECT source_id, \"window\", segment, count(*) AS n FROM seg GROUP BY ALL) GROUP BY ALL"
)
def segment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of short windows, and how many pairs a causal mask within documents lets through."""
    w = running_sum(counted(spark, sf_dir).filter("n_tokens > 0"), ["source_id"], "seq", F.col("n_tokens"), "at")
    return pack.pair_counts(w, 32, key="source_id", begin="at", tokens="n_tokens")


@query(
    f"WITH RECURSIVE {SQL_DOCS}, d AS (SELECT category, seq, n_tokens, row_number() OVER (PARTITION BY category ORDER BY seq) AS r FROM docs WHERE n_tokens > 0), f AS (SELECT category, seq, n_tokens, r, 0 AS part, n_tokens AS held FROM d WHERE r = 1"
    " UNION ALL SELECT d.category, d.seq, d.n_tokens, d.r, f.part + CASE WHEN f.held + d.n_tokens > 5000 THEN 1 ELSE 0 END, CASE WHEN f.held + d.n_tokens > 5000 THEN d.n_tokens ELSE f.held + d.n_tokens END FROM f JOIN d ON d.category = f.category AND d.r = f.r + 1) SELECT category, seq, n_tokens, part FROM f"
)
def part_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.part_roll(counted(spark, sf_dir), 5_000, key="category")


@query(f"WITH {SQL_DOCS}, {SQL_TARGETS}, {SQL_TAKEN} SELECT category AS mode, CAST(sum(n_tokens) AS BIGINT) AS actual_tokens, count(*) AS documents, max(target) AS target_tokens FROM taken GROUP BY category")
def mode_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = budget.take(counted(spark, sf_dir), targets(sources(spark), mix(spark), SHARD_TOKENS)).withColumnRenamed("category", "mode")
    return budget.shard_stats(taken, by=("mode",))


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // (SELECT count(*) // 7 FROM documents) AS INT) AS rank FROM documents QUALIFY rank < 7")
def rank_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.rank_ranges(read(spark, sf_dir, "documents").select("doc_id"), 7, order="doc_id")


@query("WITH n AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS batch FROM documents) SELECT doc_id, source, batch FROM n JOIN (SELECT source, batch FROM n GROUP BY ALL HAVING count(*) = 8) USING (source, batch) WHERE batch >= 2")
def microbatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.micro_batches(read(spark, sf_dir, "documents").select("doc_id", "source"), 8, keys=["source"], order="doc_id", start=2).select("doc_id", "source", "batch")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= ceil(0.95::DOUBLE * (SELECT count(*) FROM documents)) THEN 'train' ELSE 'validation' END AS split FROM documents")
def train_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.train_and_validation(read(spark, sf_dir, "documents").select("doc_id"), 0.05, order="doc_id")


_SHARDS = "s AS (SELECT l_orderkey AS id, CAST(sum(l_quantity) AS BIGINT) AS actual_tokens FROM lineitem GROUP BY 1), spans AS (SELECT id, actual_tokens, CAST(sum(actual_tokens) OVER (ORDER BY id) - actual_tokens AS BIGINT) AS tokens_start, CAST(sum(actual_tokens) OVER (ORDER BY id) AS BIGINT) AS tokens_end FROM s)"


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").cast("long").alias("actual_tokens"))


@query(f"WITH {_SHARDS} SELECT id, actual_tokens, tokens_start, tokens_end FROM spans")
def shard_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.spans(_shards(spark, sf_dir)).select("id", "actual_tokens", "tokens_start", "tokens_end")


@query(
    f"WITH {_SHARDS}, odd AS (SELECT id, actual_tokens, tokens_start + CASE WHEN id = 7 THEN 1 ELSE 0 END AS tokens_start, tokens_end FROM spans), c AS (SELECT 'whole' AS books, *, lag(tokens_end) OVER (ORDER BY id) AS before FROM spans UNION ALL SELECT 'shifted', *, lag(tokens_end) OVER (ORDER BY id) FROM odd)"
    " SELECT books, bool_and(coalesce(before = tokens_start, true) AND tokens_end - tokens_start = actual_tokens) AS contiguous, CAST(sum(actual_tokens) AS BIGINT) AS total, sum(actual_tokens) = (SELECT sum(l_quantity) FROM lineitem) AS conserved FROM c GROUP BY books"
)
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The books of all shards, and the same with one shard's start shifted."""
    s = shard_spans(spark, sf_dir)
    shifted = s.withColumn("tokens_start", F.col("tokens_start") + (F.col("id") == 7).cast("long"))
    total = read(spark, sf_dir, "lineitem").agg(F.sum("l_quantity").cast("long").alias("prepared"))
    rows = [budget.conserved(x, F.lit(0)).drop("conserved").withColumn("books", F.lit(name)) for name, x in (("whole", s), ("shifted", shifted))]
    # one row joins two
    return rows[0].unionByName(rows[1]).join(F.broadcast(total)).select("books", "contiguous", "total", (F.col("total") == F.col("prepared")).alias("conserved"))


_S = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"
_CHAT = f"m AS (SELECT conv_id, turn, CASE WHEN lower(role) IN ('human', 'user') THEN 'user' WHEN lower(role) IN ('gpt', 'assistant', 'bot') THEN 'assistant' ELSE lower(role) END AS role, {_S} AS content FROM conversations WHERE {_S} <> '')"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return by.select("conv_id", sft.messages(by).alias("messages")).filter("messages IS NOT NULL")


@query(f"WITH {_CHAT} SELECT conv_id, string_agg('<|im_start|>' || CASE WHEN role IN ('system', 'user', 'assistant') THEN role ELSE 'user' END || e'\\n' || content || e'<|im_end|>\\n', '' ORDER BY turn) AS text FROM m GROUP BY conv_id HAVING bool_or(role = 'assistant')")
def chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", sft.chat_text(F.col("messages")).alias("text"))


@query(SQL["chat_template"])
def chat_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in each of the public shapes: a list under one of four names, roles and contents under several."""
    c, n = read(spark, sf_dir, "conversations"), F.col("conv_id") % 4
    shapes = {"messages": ("role", "content"), "conversations": ("from", "value"), "conversation": ("speaker", "text"), "data": ("role", "message")}
    lists = [F.array_sort(F.collect_list(F.when(n == k, F.struct("turn", F.col("role").alias(role), F.col("text").alias(content))))).alias(name) for k, (name, (role, content)) in enumerate(shapes.items())]
    by = c.groupBy("conv_id").agg(*lists)
    return by.select("conv_id", sft.messages(by).alias("m")).filter("m IS NOT NULL").select("conv_id", sft.chat_text(F.col("m")).alias("text"))


def _encode(x):
    """Words' lengths in place of a tokenizer's ids."""
    return F.transform(words(x), lambda w: F.length(w))


@query(
    rf"WITH {_CHAT}, e AS (SELECT conv_id, turn, role, content, regexp_extract_all(content, '[^\x20\x09-\x0D]+') AS w, length('<|im_start|>' || CASE WHEN role IN ('system', 'user', 'assistant') THEN role ELSE 'user' END)::INT AS h FROM m)"
    " SELECT conv_id, CAST(sum(2 + len(w)) AS BIGINT) AS n, CAST(sum(h + 10 + coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)) AS BIGINT) AS id_sum, CAST(sum(CASE WHEN role = 'assistant' THEN 1 + len(w) ELSE 0 END) AS BIGINT) AS labelled FROM e GROUP BY conv_id HAVING bool_or(role = 'assistant')"
)
def labels_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sft.computed(_messages(spark, sf_dir), "x", sft.labelled(F.col("messages"), _encode))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    return x.select("conv_id", F.size("x.ids").cast("long").alias("n"), total(F.col("x.ids")).alias("id_sum"), F.size(F.filter("x.labels", lambda v: v != sft.IGNORED)).cast("long").alias("labelled"))


_PAIR = f"p AS (SELECT conv_id, max({_S}) FILTER (turn = 0) AS instruction, max({_S}) FILTER (turn = 1) AS output FROM conversations GROUP BY conv_id)"


@query(f"WITH {_PAIR} SELECT conv_id, '<|im_start|>user' || e'\\n' || instruction || e'\\n\\nBe brief.\\n<|im_end|>\\n<|im_start|>assistant\\n' AS prompt, output || e'\\n<|im_end|>\\n' AS completion FROM p WHERE instruction <> '' AND output <> ''")
def prompt_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("instruction"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("output"))
    by = by.withColumn("context", F.lit("Be brief."))
    pair = by.select("conv_id", sft.prompt_and_completion(by).alias("p")).filter("p IS NOT NULL")
    prompt, completion = sft.pair_texts(F.col("p.prompt"), F.col("p.completion"))
    return pair.select("conv_id", prompt.alias("prompt"), completion.alias("completion"))


@query(
    f"WITH r AS (SELECT conv_id, turn, {_S} AS t, CASE WHEN turn % 3 = 1 THEN (turn * 7 % 5)::DOUBLE ELSE (count(*) OVER (PARTITION BY conv_id) - (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)) * 1e-6::DOUBLE END AS rating FROM conversations)"
    " SELECT conv_id, coalesce(max_by(t, (rating, -turn)) FILTER (t <> ''), '') AS best FROM (SELECT * FROM r) GROUP BY conv_id"
)
def best_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    model = F.concat(F.lit("m"), F.col("turn"))
    by = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", model.alias("model")))).alias("r"), F.collect_list(F.when(F.col("turn") % 3 == 1, F.struct(model.alias("model"), (F.col("turn") * 7 % 5).cast("double").alias("rating")))).alias("a"))
    return by.select("conv_id", sft.best_response(F.transform("r", lambda x: F.struct(x["text"].alias("text"), x["model"].alias("model"))), F.col("a")).alias("best"))


@query(
    f"WITH d AS (SELECT doc_id, list_transform({SQL_WORDS}, lambda w: length(w)) AS ids FROM documents), s AS (SELECT doc_id, ids, CASE WHEN len(ids) > 65 THEN CAST(floor({sql_uniform("'42'", 'doc_id', "'raw'")} * (len(ids) - 64)) AS BIGINT) ELSE 0 END AS start FROM d WHERE len(ids) >= 8)"
    " SELECT doc_id, CAST(len(ids[start + 1:start + 65]) AS INT) AS n, CAST(list_sum(ids[start + 1:start + 65]) AS BIGINT) AS total FROM s"
)
def truncate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sft.computed(read(spark, sf_dir, "documents").select("doc_id", "text"), "ids", _encode(F.col("text")))
    d = sft.computed(d, "x", sft.truncated(sft.raw_labelled(F.col("ids")), 64, "raw_completion", "42", F.col("doc_id"), "raw"))
    return d.select("doc_id", F.size("x.ids").alias("n"), F.aggregate("x.ids", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query(
    rf"WITH e AS (SELECT conv_id // 4 AS batch, conv_id, turn, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: length(w)) AS ids FROM conversations), b AS (SELECT batch, max(len(ids)) AS n FROM e GROUP BY batch)"
    " SELECT batch, conv_id * 100 + turn AS item, CAST(n - 1 AS INT) AS width, CAST(greatest(len(ids) - 1, 0) AS INT) AS counted, CAST(coalesce(list_sum(ids[2:]), 0) AS BIGINT) AS y_sum FROM e JOIN b USING (batch) WHERE n > 1"
)
def collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 4).alias("batch"), (F.col("conv_id") * 100 + F.col("turn")).alias("item"), _encode(F.col("text")).alias("ids")).withColumn("labels", F.col("ids"))
    most = c.groupBy("batch").agg(F.max(F.size("ids")).alias("n")).filter("n > 1").select("batch")
    x = sft.collated(c.join(most, "batch", "left_semi"), batch="batch", order="item", pad=0)
    return x.select("batch", "item", F.size("x").alias("width"), F.size(F.filter("mask", lambda m: m)).alias("counted"), F.aggregate("y", F.lit(0).cast("long"), lambda a, v: a + v).alias("y_sum"))


@query(
    "SELECT item_id, regexp_replace(array_to_string(list_transform(string_split_regex(t, '\\r\\n|\\n|\\r'), lambda x: '# ' || regexp_replace(x, '\\s+$', '')), e'\\n'), '\\s+$', '') || e'\\n' AS block, '<fim_prefix>' || regexp_replace(array_to_string(list_transform(string_split_regex(t, '\\r\\n|\\n|\\r'), lambda x: '# ' || regexp_replace(x, '\\s+$', '')), e'\\n'), '\\s+$', '') || e'\\n\\n<fim_suffix><fim_middle>' AS prompt"
    " FROM (SELECT item_id, regexp_replace(substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 6000), '\\s+$', '') AS t FROM benchmark)"
)
def comment_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    return b.select("item_id", rl.commented("text").alias("block"), rl.fim_prompt(rl.prefix("text", F.lit(None).cast("string")), F.lit("")).alias("prompt"))


@query("SELECT item_id, text || e'\\ndef f(x):\\n    ' AS code FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, regexp_replace(text || e'\\ndef f(x):\\n    return x', '\\s+$', '') FROM benchmark WHERE item_id % 2 = 1")
def trailing_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    stub = F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit("\ndef f(x):\n    pass\n\n"))).otherwise(F.concat("text", F.lit("\ndef f(x):\n    return x\n")))
    return b.select("item_id", rl.without_stub(stub).alias("code"))


@query(
    "SELECT event_id, CAST(least(1 + event_id % 4, 1 + event_id % 3) AS INT) AS n, CASE WHEN event_id % 2 = 0 THEN 'solve' ELSE '' END AS fn_name FROM events WHERE event_id % 5 <> 0"
)
def tests_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    i = F.col("event_id")
    lists = F.struct(F.array_repeat(F.col("event_type"), (1 + i % 4).cast("int")).alias("inputs"), F.array_repeat(F.col("props"), (1 + i % 3).cast("int")).alias("outputs"), F.when(i % 2 == 0, "solve").alias("fn_name"))
    x = e.select("event_id", F.when(i % 5 == 0, "not json").otherwise(F.to_json(lists)).alias("payload"))
    return rl.with_tests(x, "payload").select("event_id", F.size("tests.inputs").alias("n"), "tests.fn_name")


@query(rf"SELECT conv_id, CAST(sum(CASE WHEN regexp_replace({_S}, '\s+', ' ', 'g') = regexp_replace({_S.replace('text', 'first')}, '\s+', ' ', 'g') THEN 1 ELSE 0 END) AS BIGINT) AS passed, count(*) AS total, round(avg(CASE WHEN regexp_replace({_S}, '\s+', ' ', 'g') = regexp_replace({_S.replace('text', 'first')}, '\s+', ' ', 'g') THEN 1.0 ELSE 0.0 END), 6) AS reward FROM (SELECT *, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS first FROM conversations) GROUP BY conv_id")
def reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("expected"))
    r = rl.rewards(c.join(first, "conv_id"), by="conv_id", passed=rl.same_output(F.col("text"), F.col("expected")))
    return r.withColumn("reward", F.round("reward", 6))


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN [1, 1, 2, 2, 3, 3] WHEN item_id % 3 = 1 THEN [1, 2, 3, 4, 4, 4] ELSE [0, 0, 0, 0, 0, 0] END AS v FROM benchmark")
def reward_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    values = F.when(F.col("item_id") % 3 == 0, F.array(*map(F.lit, (1, 2, 3)))).when(F.col("item_id") % 3 == 1, F.array(*map(F.lit, (1, 2, 3, 4))))
    return b.select("item_id", rl.aligned(values, F.lit(6), F.lit(0)).alias("v"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN event_type = 'other' ELSE true END AS equal FROM events")
def tolerant_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reward's comparison of literals, floats and nested values."""
    e = read(spark, sf_dir, "events")
    i = F.col("event_id")
    actual = F.when(i % 4 == 0, F.concat(F.lit("["), "value", F.lit(", 1]"))).when(i % 4 == 1, F.col("props")).otherwise(F.col("event_type"))
    expected = F.when(i % 4 == 0, F.concat(F.lit("("), (F.col("value") * 1.0000000001).cast("string"), F.lit(", 1)"))).when(i % 4 == 1, F.col("props")).when(i % 4 == 2, F.concat(F.lit("  "), "event_type", F.lit("\n"))).otherwise("other")
    return e.select("event_id", rl.tolerant_equal(actual, expected).alias("equal"))
