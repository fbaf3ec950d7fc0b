"""Queries on judgments, evaluation, evidence, raw search, times of questions, and imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gistmill.functions import fulltext, phrases, rendering, scores, text
from gistmill.lineage import fresh
from gistmill.operators import curation, evaluation, filters, graph, judgments, lineage_sets, listing, retrieval, writes
from gistmill.plans.registry import query
from gistmill.plans.retrieval_queries import ASKED, COVERS, IN_SCOPES, SCOPES
from gistmill.sources import fixtures as fx
from gistmill.sources import transcripts

NOW = f"TIMESTAMP '{fx.NOW}'"
LIVE = f"status = 'active' AND (valid_until IS NULL OR valid_until > {NOW})"

# Lists of forty, each row with a judgment; some lists have one missing.
_JUDGED = "SELECT no // 40 AS q, id, no % 40 + 1 AS rank, CASE WHEN no // 40 % 3 = 2 AND no % 40 = 7 THEN NULL ELSE (no * 37 % 101) / 101.0 END AS value FROM memories"
_WHOLE = f"j AS ({_JUDGED}), w AS (SELECT *, count(*) FILTER (rank <= 30 AND value IS NULL) OVER (PARTITION BY q) = 0 AS whole FROM j)"


def _judged(spark, sf):
    n = F.col("no")
    value = F.when((F.floor(n / 40) % 3 == 2) & (n % 40 == 7), None).otherwise((n * 37 % 101) / 101.0)
    return fx.memories(spark, sf).select(F.floor(n / 40).alias("q"), "id", (n % 40 + 1).cast("int").alias("rank"), value.alias("value"))


@query("semantic_rerank", f"WITH {_WHOLE} SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN whole AND rank > 30 THEN 1 ELSE 0 END, CASE WHEN whole AND rank <= 30 THEN -value ELSE 0 END, rank) AS rank FROM w")
def semantic_rerank(spark, sf):
    return judgments.reranked(_judged(spark, sf), "q")


@query("semantic_filter", f"WITH {_WHOLE} SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN whole THEN -value ELSE 0 END, rank) AS rank FROM w WHERE NOT whole OR rank <= 30 AND value >= 0.5")
def semantic_filter(spark, sf):
    return judgments.in_mode(_judged(spark, sf), "filter", "q", 0.5)


@query("context_contributions", f"WITH {_WHOLE} SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN whole THEN -value ELSE 0 END, rank) AS rank FROM w WHERE NOT whole OR rank <= 30 AND value >= 0.7")
def context_contributions(spark, sf):
    return judgments.in_mode(_judged(spark, sf), "contribution", "q")


@query("semantic_verify", f"WITH j AS ({_JUDGED}) SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY rank) AS rank FROM j WHERE value IS NULL OR value >= 0.5")
def semantic_verify(spark, sf):
    return judgments.in_mode(_judged(spark, sf), "verify", "q", 0.5)


@query("duplicate_veto", f"SELECT id, coalesce(value, 0) >= 0.9 AS vetoed FROM ({_JUDGED})")
def duplicate_veto(spark, sf):
    return judgments.vetoed(_judged(spark, sf)).select("id", "vetoed")


@query("judgment_validity", """WITH a AS (SELECT no, CASE no % 4 WHEN 0 THEN 'noul' WHEN 1 THEN 'choice' WHEN 2 THEN 'score' ELSE 'other' END AS kind, CASE no % 4 WHEN 0 THEN (no % 13) / 10.0 ELSE (no % 5) / 2.0 END AS value, CASE no % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'z' END AS choice,
 (no % 6) / 10.0 AS pa, 0.5 AS pb, CASE WHEN no % 7 = 3 THEN 0.9 ELSE 0.5 - (no % 6) / 10.0 END AS pc, CASE WHEN no % 11 = 5 THEN 1.5 ELSE 0.5 END AS conf, no % 9 = 4 AS missing FROM memories),
 s AS (SELECT *, CASE WHEN missing THEN 'wrong_options' WHEN abs(pa + pb + pc - 1) > 0.015 + 1e-9 THEN 'invalid_distribution' WHEN conf > 1 THEN 'out_of_range' END AS shared, pb + 2 * pc AS mean FROM a)
 SELECT no, CASE kind WHEN 'noul' THEN CASE WHEN value > 1 THEN 'out_of_range' END WHEN 'choice' THEN coalesce(shared, CASE WHEN choice = 'z' OR CASE choice WHEN 'a' THEN pa ELSE pb END < greatest(pa, pb, pc) THEN 'invalid_choice' END)
 WHEN 'score' THEN coalesce(shared, CASE WHEN value > 2 THEN 'out_of_range' WHEN abs(value - mean) > 0.02 + 1e-9 THEN 'inconsistent_score' END) ELSE 'wrong_type' END AS reason FROM s""")
def judgment_validity(spark, sf):
    n = F.col("no")
    kind = F.when(n % 4 == 0, "noul").when(n % 4 == 1, "choice").when(n % 4 == 2, "score").otherwise("other")
    value = F.when(n % 4 == 0, (n % 13) / 10.0).otherwise((n % 5) / 2.0)
    choice = F.when(n % 3 == 0, "a").when(n % 3 == 1, "b").otherwise("z")
    pc = F.when(n % 7 == 3, 0.9).otherwise(0.5 - (n % 6) / 10.0)
    whole = F.create_map(F.lit("a"), (n % 6) / 10.0, F.lit("b"), F.lit(0.5), F.lit("c"), pc)
    p = F.when(n % 9 == 4, F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), F.lit(0.5))).otherwise(whole)
    reason = judgments.unsound(kind, value, choice, F.array(*map(F.lit, "abc")), p, F.when(n % 11 == 5, 1.5).otherwise(0.5))
    return fx.memories(spark, sf).select("no", reason.alias("reason"))


_FOLD = text.casefolded_sql(text.stripped_sql("content"))


@query("accepted_rewrites", f"""WITH g AS (SELECT session_id, turn, {text.stripped_sql('content')} AS said, {_FOLD} AS key FROM messages), f AS (SELECT session_id, turn, said, key, first_value(key) OVER (PARTITION BY session_id ORDER BY turn) AS asked FROM g),
 r AS (SELECT session_id, key, min(turn) AS turn, arg_min(said, turn) AS said FROM f WHERE said <> '' AND length(said) <= 512 AND key <> asked GROUP BY session_id, key), n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS nth FROM r)
 SELECT session_id, nth, said AS rewrite FROM n WHERE nth <= 3""")
def accepted_rewrites(spark, sf):
    """Each session's first turn as the query, its turns as what was proposed in its place."""
    g = fx.messages(spark, sf)
    first = g.groupBy("session_id").agg(F.min_by("content", "turn").alias("query"))
    return judgments.accepted_rewrites(g.join(first, "session_id").select("session_id", F.col("turn").alias("place"), "query", F.col("content").alias("rewrite")), "session_id")


@query("parsed_ops", f"""SELECT id, CASE WHEN op NOT IN ('ADD', 'UPDATE', 'DELETE') THEN 'unknown_op' WHEN op IN ('UPDATE', 'DELETE') AND no % 13 = 1 THEN 'no_target' WHEN op <> 'DELETE' AND said = '' THEN 'no_text' WHEN op <> 'DELETE' AND length(said) > 200 THEN 'too_long' WHEN no % 19 = 3 THEN 'invalid_kind' WHEN no % 23 = 4 THEN 'invalid_tags'
 WHEN op <> 'DELETE' AND no % 29 = 5 THEN 'no_evidence' WHEN no % 29 <> 5 AND no % 7 = 6 THEN 'invalid_evidence' END AS reason FROM (SELECT *, CASE no % 5 WHEN 0 THEN 'ADD' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'DELETE' WHEN 3 THEN 'ADD' ELSE 'MOVE' END AS op, {text.stripped_sql("CASE WHEN no % 3 = 0 THEN text ELSE substr(text, 1, 60) END")} AS said FROM memories)""")
def parsed_ops(spark, sf):
    n = F.col("no")
    op = F.when(n % 5 == 0, "add").when(n % 5 == 1, "UPDATE").when(n % 5 == 2, "Delete").when(n % 5 == 3, "ADD").otherwise("MOVE")
    cited = F.array(F.struct(F.lit(4).cast("bigint").alias("message_id"), F.lit(0).alias("start_char"), F.when(n % 7 == 6, 0).otherwise(9).alias("end_char"), F.lit("").alias("quote")))
    reason = judgments.parsed_op(
        op, F.when(n % 13 != 1, F.lit("7")), F.when(n % 3 == 0, F.col("text")).otherwise(F.substring("text", 1, 60)), F.when(n % 19 == 3, "k" * 65).otherwise("fact"), F.when(n % 23 == 4, F.array(F.lit(" "))).otherwise(F.array(F.lit("t"))), F.when(n % 29 != 5, cited)
    )
    return fx.memories(spark, sf).select("id", reason.alias("reason"))


@query("reconciled_context", "SELECT id, CASE no % 4 WHEN 0 THEN 'source_workspace=' || scope_id WHEN 1 THEN 'lang=' || lang WHEN 2 THEN NULL ELSE CASE WHEN lang = scope_id THEN NULL ELSE 'source_workspace=' || scope_id END END AS context FROM memories")
def reconciled_context(spark, sf):
    """A claim names a workspace by another key, a language by its own, something that the session has not, or both keys' workspace."""
    n = F.col("no")
    session = F.create_map(F.lit("source_workspace"), "scope_id", F.lit("lang"), "lang")
    own = F.when(n % 4 == 0, F.create_map(F.lit("workspace"), "scope_id")).when(n % 4 == 1, F.create_map(F.lit("lang"), "lang")).when(n % 4 == 2, F.create_map(F.lit("lang"), F.lit("nowhere"))).otherwise(F.create_map(F.lit("source_workspace"), "scope_id"))
    found = judgments.reconciled(own, session)
    return fx.memories(spark, sf).select("id", F.array_join(F.transform(F.map_entries(found), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("context"))


# Cases of forty rows; one in four expects nothing.
_CASES = "c AS (SELECT DISTINCT no // 40 AS q FROM memories), e AS (SELECT no // 40 AS q, id FROM memories WHERE no % 5 = 0 AND no // 40 % 4 <> 3), r AS (SELECT no // 40 AS q, id, row_number() OVER (PARTITION BY no // 40 ORDER BY no * 31 % 41, no) AS rank FROM memories WHERE no * 31 % 41 < 18 AND no // 40 % 8 <> 7)"


def _cases(spark, sf):
    m, n = fx.memories(spark, sf).select("no", "id"), F.col("no")
    from pyspark.sql import Window

    q = F.floor(n / 40).alias("q")
    place = F.row_number().over(Window.partitionBy(F.floor(n / 40)).orderBy(n * 31 % 41, "no"))
    results = m.filter((n * 31 % 41 < 18) & (F.floor(n / 40) % 8 != 7)).select(q, "id", "no", place.alias("rank"))
    return m.select(q).distinct(), results, m.filter((n % 5 == 0) & (F.floor(n / 40) % 4 != 3)).select(q, "id")


@query("eval_hybrid", f"""WITH {_CASES}, g AS (SELECT r.q, count(*) AS n, count(e.id) AS hit, arg_min(e.id IS NOT NULL, rank) AS first FROM r LEFT JOIN e ON e.q = r.q AND e.id = r.id GROUP BY r.q), w AS (SELECT q, count(*) AS wanted FROM e GROUP BY q),
 j AS (SELECT c.q, coalesce(n, 0) AS n, coalesce(hit, 0) AS hit, coalesce(first, false) AS first, coalesce(wanted, 0) AS wanted FROM c LEFT JOIN g ON g.q = c.q LEFT JOIN w ON w.q = c.q)
 SELECT count(*) AS queries, count(*) FILTER (wanted > 0) AS answerable, count(*) FILTER (wanted > 0 AND first) AS top1_correct, CAST(sum(hit) AS BIGINT) AS relevant_retained, CAST(sum(wanted) AS BIGINT) AS relevant_total, count(*) FILTER (wanted = 0) AS unanswerable,
 count(*) FILTER (wanted = 0 AND n = 0) AS correct_abstentions, CAST(sum(n - hit) AS BIGINT) AS irrelevant_returned FROM j""")
def eval_hybrid(spark, sf):
    return evaluation.hybrid_metrics(*_cases(spark, sf))


@query("eval_ranking", f"""WITH s AS (SELECT q, rank AS place, coalesce(value, 0) AS score, CAST(id AS BIGINT) % 5 = 0 AND q % 4 <> 3 AS expected FROM ({_JUDGED})), o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, place) AS rank, score >= 0.95 AS kept FROM s),
 c AS (SELECT q, count(*) FILTER (expected) AS wanted, min(rank) FILTER (expected) AS first, count(*) FILTER (kept) AS kept, count(*) FILTER (kept AND expected) AS hit FROM o GROUP BY q)
 SELECT count(*) AS n, count(*) FILTER (wanted > 0) AS answerable, round(avg(CASE WHEN wanted > 0 THEN CASE WHEN first = 1 THEN 1 ELSE 0 END END), 4) AS top1, round(avg(1.0 / first), 4) AS mrr, count(*) FILTER (wanted = 0 AND kept = 0) AS correct_abstentions,
 count(*) FILTER (wanted > 0 AND kept = 0) AS false_empty, CAST(sum(hit) FILTER (wanted > 0) AS BIGINT) AS relevant_retained, CAST(sum(wanted) AS BIGINT) AS relevant_total FROM c""")
def eval_ranking(spark, sf):
    expected = (F.col("id").cast("long") % 5 == 0) & (F.col("q") % 4 != 3)
    return evaluation.ranking_metrics(_judged(spark, sf).select("q", F.col("rank").alias("place"), F.coalesce("value", F.lit(0.0)).alias("score"), expected.alias("expected")), 0.95)


@query("eval_context", f"""WITH {_CASES}, x AS (SELECT q, id, rank AS pos, unnest(CASE WHEN CAST(id AS BIGINT) % 6 = 0 THEN [] ELSE [CAST(id AS BIGINT) % 7, 10 + CAST(id AS BIGINT) % 2] END) AS facet FROM r), f AS (SELECT *, min(pos) OVER (PARTITION BY q, facet) AS first FROM x),
 s AS (SELECT q, count(*) FILTER (stale) AS redundant FROM (SELECT q, id, bool_and(first < pos) AS stale FROM f GROUP BY q, id) GROUP BY q), w AS (SELECT DISTINCT q, CAST(id AS BIGINT) % 7 AS facet FROM e),
 v AS (SELECT w.q, count(*) AS expected, count(h.q) AS covered FROM w LEFT JOIN (SELECT DISTINCT q, facet FROM x) h ON h.q = w.q AND h.facet = w.facet GROUP BY w.q), i AS (SELECT r.q, count(*) AS n, count(*) FILTER (e.id IS NULL) AS irrelevant FROM r LEFT JOIN e ON e.q = r.q AND e.id = r.id GROUP BY r.q),
 j AS (SELECT coalesce(expected, 0) AS expected, coalesce(covered, 0) AS covered, coalesce(redundant, 0) AS redundant, coalesce(n, 0) AS n, coalesce(irrelevant, 0) AS irrelevant FROM c LEFT JOIN s ON s.q = c.q LEFT JOIN v ON v.q = c.q LEFT JOIN i ON i.q = c.q)
 SELECT count(*) AS queries, CAST(sum(covered) AS BIGINT) AS details_retained, CAST(sum(expected) AS BIGINT) AS details_expected, count(*) FILTER (expected > 0 AND covered = expected) AS complete, CAST(sum(irrelevant) AS BIGINT) AS irrelevant, CAST(sum(redundant) AS BIGINT) AS redundant,
 count(*) FILTER (expected = 0 AND n = 0) AS correct_empty, count(*) FILTER (expected = 0) AS unanswerable FROM j""")
def eval_context(spark, sf):
    cases, results, expected = _cases(spark, sf)
    n = F.col("id").cast("long")
    facets = F.when(n % 6 == 0, F.array().cast("array<bigint>")).otherwise(F.array(n % 7, 10 + n % 2))
    return evaluation.context_metrics(cases, results.select("q", "id", F.col("rank").alias("pos"), facets.alias("facets")), expected, expected.select("q", (n % 7).alias("facet")))


_TOKENS = r"greatest(1, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')))"


@query("budget_ablation", f"""WITH RECURSIVE r AS (SELECT b, no // 40 AS q, row_number() OVER (PARTITION BY b, no // 40 ORDER BY no) AS rank, {_TOKENS} + 6 AS cost FROM memories, (SELECT unnest([80, 160, 320]) AS b)),
 f AS (SELECT DISTINCT b, q, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n FROM r UNION ALL SELECT f.b, f.q, r.rank, CASE WHEN f.used + r.cost <= f.b AND f.n < 30 THEN f.used + r.cost ELSE f.used END, CASE WHEN f.used + r.cost <= f.b AND f.n < 30 THEN f.n + 1 ELSE f.n END FROM f JOIN r ON r.b = f.b AND r.q = f.q AND r.rank = f.rank + 1)
 SELECT b AS budget, q, max(used) AS used, max(n) AS n FROM f GROUP BY b, q HAVING max(n) > 0""")
def budget_ablation(spark, sf):
    """What three budgets hold of each list, rows too large skipped."""
    n = F.col("no")
    ranked = fx.memories(spark, sf).select(F.floor(n / 40).alias("q"), (n % 40 + 1).cast("int").alias("rank"), (text.token_count(F.col("text")) + 6).alias("cost"))
    out = None
    for budget in (80, 160, 320):
        held = retrieval.within_budget(ranked, budget, 30, "q").groupBy("q").agg(F.max("used").alias("used"), F.count("*").alias("n")).select(F.lit(budget).alias("budget"), "q", "used", "n")
        out = held if out is None else out.unionAll(held)
    return out


@query("eval_extraction", """WITH c AS (SELECT no // 40 AS q, CASE no % 40 WHEN 0 THEN 'the' WHEN 1 THEN '[0-9]{3}' ELSE 'idiot' END AS pattern, no % 40 = 2 AS forbidden FROM memories WHERE no % 40 < 3), f AS (SELECT no // 40 AS q, text, no % 23 <> 0 AS cited FROM memories WHERE no % 3 = 0),
 j AS (SELECT c.*, f.text, coalesce(regexp_matches(f.text, c.pattern), false) AS hit FROM c LEFT JOIN f ON f.q = c.q), p AS (SELECT q, pattern, forbidden, bool_or(hit) AS hit FROM j GROUP BY ALL), g AS (SELECT DISTINCT q, text FROM j WHERE hit AND NOT forbidden)
 SELECT count(*) FILTER (NOT forbidden) AS expected, count(*) FILTER (NOT forbidden AND hit) AS recalled, count(*) FILTER (forbidden AND hit) AS leaks, (SELECT count(*) FROM f WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.q = f.q AND g.text = f.text)) AS false_positives,
 (SELECT count(*) FROM f WHERE NOT cited) AS fabricated, round(count(*) FILTER (NOT forbidden AND hit) / count(*) FILTER (NOT forbidden), 4) AS recall FROM p""")
def eval_extraction(spark, sf):
    m, n = fx.memories(spark, sf), F.col("no")
    q = F.floor(n / 40).alias("q")
    cases = m.filter(n % 40 < 3).select(q, F.when(n % 40 == 0, "the").when(n % 40 == 1, "[0-9]{3}").otherwise("idiot").alias("pattern"), (n % 40 == 2).alias("forbidden"))
    return evaluation.extraction_metrics(cases, m.filter(n % 3 == 0).select(q, "text", (n % 23 != 0).alias("cited")))


@query("eval_readiness", "SELECT kind, count(*) AS n, CAST(sum(tokens_out % 5) AS BIGINT) AS kept, CAST(sum(tokens_out % 3) AS BIGINT) AS irrelevant, count(*) FILTER (id % 4 = 0 AND id % 8 = 0) AS abstained, count(*) FILTER (tokens_in > 2000) AS over_budget, quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95 FROM calls GROUP BY kind")
def eval_readiness(spark, sf):
    n = F.col("id")
    rows = fx.calls(spark, sf).select("kind", "latency", (F.col("tokens_out") % 5).alias("kept"), (F.col("tokens_out") % 3).alias("irrelevant"), F.when(n % 4 == 0, 0).otherwise(2).alias("wanted"), F.when(n % 8 == 0, 0).otherwise(3).alias("returned"), F.col("tokens_in").alias("used"), F.lit(2000).alias("budget"))
    return evaluation.readiness(rows, "kind")


@query("raw_search", f"""WITH a AS (SELECT v AS q FROM vectors WHERE no = 0), s AS (SELECT g.id AS message_id, session_id, scope_id, content AS text, created_at, list_dot_product(v, q) AS s FROM messages g JOIN vectors v ON v.no = g.session_id, a WHERE role = 'user' AND {IN_SCOPES})
 SELECT message_id, session_id, scope_id, text, created_at, round(s, 4) AS similarity FROM s ORDER BY s DESC, message_id LIMIT 30""")
def raw_search(spark, sf):
    v = fx.vectors(spark, sf)
    turns = fx.messages(spark, sf).join(v.select(F.col("no").alias("session_id"), "v"), "session_id")
    return retrieval.raw_search(turns, F.array(*map(F.lit, v.filter("no = 0").select("v").first()[0])), SCOPES, expression={"all": [{"field": "kind", "op": "eq", "value": "evidence"}, {"field": "subject_id", "op": "absent"}]})


_RANKED = f"WITH base AS (SELECT id, text FROM memories), {COVERS} SELECT id, round(covers, 6) AS rank FROM lh"


@query("fulltext_match", _RANKED)
def fulltext_match(spark, sf):
    """Memories that hold all words of any term of a query, in whatever form, ranked by how closely together."""
    terms = fulltext.asked(ASKED)
    rows = fx.memories(spark, sf).select("id", fulltext.cover_density(fulltext.positions(F.col("text"), fulltext.wanted(terms)), terms).alias("rank"))
    return rows.filter("rank > 0").select("id", F.round("rank", 6).alias("rank"))


@query("postings_rank", _RANKED)
def postings_rank(spark, sf):
    """The same from a stored index, of which the query reads its own stems' rows only."""
    path = fresh(spark)
    fulltext.write_postings(fx.memories(spark, sf), path)
    found = fulltext.read_postings(spark, path, fulltext.wanted(fulltext.asked(ASKED)))
    return fulltext.ranked(found, ASKED).select("id", F.round("rank", 6).alias("rank"))


@query("question_times")
def question_times(spark, sf):
    """What each user turn says about time; plain Python rules, held against examples by tests."""
    import datetime as dt

    g = fx.messages(spark, sf).filter("role = 'user'")
    return g.select("id", phrases.question_time(F.col("content"), dt.date.fromisoformat(fx.NOW[:10])).alias("t")).select("id", "t.*")


@query("dated_costs", "SELECT id, round((tokens_in * CASE WHEN model = 'small' THEN 0.1 WHEN model = 'medium' THEN CASE WHEN CAST(created_at AS DATE) > DATE '2024-01-15' THEN 0.75 ELSE 0.5 END ELSE 2.0 END + tokens_out * CASE WHEN model = 'small' THEN 0.4 WHEN model = 'medium' THEN CASE WHEN CAST(created_at AS DATE) > DATE '2024-01-15' THEN 2.0 ELSE 1.5 END ELSE 8.0 END) / 1e6, 8) AS cost FROM calls")
def dated_costs(spark, sf):
    """One model's price changes after a day; a model that nobody knows costs as the dearest."""
    before, after = {"small": (0.1, 0.4), "medium": (0.5, 1.5), "huge": (2.0, 8.0)}, {"medium": (0.75, 2.0)}
    return fx.calls(spark, sf).select("id", F.round(scores.dated_cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out"), F.to_date("created_at"), before, after, "2024-01-15"), 8).alias("cost"))


@query("evidence_links", """SELECT e.memory_id, e.message_id, coalesce(string_agg(CAST(k.revision AS VARCHAR), ',' ORDER BY k.revision), '') AS revisions, bool_or(coalesce(k.revision = m.revision, false)) AS current, e.sha <> 'broken' AS whole
 FROM evidence e JOIN messages g ON g.id = e.message_id JOIN memories m ON m.id = e.memory_id LEFT JOIN (SELECT *, bool_and(same) OVER (PARTITION BY memory_id ORDER BY revision) AS kept FROM (SELECT *, coalesce(text = lag(text) OVER (PARTITION BY memory_id ORDER BY revision), true) AS same FROM revisions)) k ON k.memory_id = e.memory_id AND k.kept
 GROUP BY e.memory_id, e.message_id, e.sha""")
def evidence_links(spark, sf):
    """Each citation with the revisions that it supports, in order, whether the current one is among them, and whether its span is what was cited."""
    return lineage_sets.evidence_links(fx.evidence(spark, sf), fx.messages(spark, sf), fx.memories(spark, sf), fx.revisions(spark, sf))


@query("session_memories", "SELECT DISTINCT g.session_id, e.memory_id, m.kind, m.status FROM evidence e JOIN messages g ON g.id = e.message_id JOIN memories m ON m.id = e.memory_id")
def session_memories(spark, sf):
    g = fx.messages(spark, sf).select(F.col("id").alias("message_id"), "session_id")
    m = fx.memories(spark, sf).select(F.col("id").alias("memory_id"), "kind", "status")
    return fx.evidence(spark, sf).join(g, "message_id").select("session_id", "memory_id").distinct().join(m, "memory_id").select("session_id", "memory_id", "kind", "status")


@query("predecessors", "SELECT from_id AS id, string_agg(to_id, ',' ORDER BY to_id) AS predecessors, count(*) AS n FROM relations WHERE relation = 'updates' GROUP BY from_id")
def predecessors(spark, sf):
    e = fx.relations(spark, sf).filter("relation = 'updates'").groupBy(F.col("from_id").alias("id")).agg(F.sort_array(F.collect_list("to_id")).alias("x"))
    return e.select("id", F.array_join("x", ",").alias("predecessors"), F.size("x").cast("long").alias("n"))


@query("fenced_claims", "SELECT id, collection FROM outbox WHERE (id, attempts) IN (SELECT event_id, event_id % 7 FROM events WHERE event_type = 'click')")
def fenced_claims(spark, sf):
    """Deliveries whose claim still has the token that it was given."""
    n = F.col("event_id")
    held = fx.table(spark, sf, "events").filter("event_type = 'click'").select(n.alias("id"), (n % 7).alias("attempts"))
    return fx.outbox(spark, sf).join(held, ["id", "attempts"], "left_semi").select("id", "collection")


@query("job_scopes", "SELECT DISTINCT g.user_id, m.scope_id FROM messages g JOIN evidence e ON e.message_id = g.id JOIN memories m ON m.id = e.memory_id")
def job_scopes(spark, sf):
    """Scopes that each user's work has touched."""
    e = fx.evidence(spark, sf).join(fx.messages(spark, sf).select(F.col("id").alias("message_id"), "user_id"), "message_id").select("memory_id", "user_id").distinct()
    return e.join(fx.memories(spark, sf).select(F.col("id").alias("memory_id"), "scope_id"), "memory_id").select("user_id", "scope_id").distinct()


_POLICIES = "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'src' || CAST(n_nationkey % 4 AS VARCHAR) END AS scope_id, CASE n_nationkey % 2 WHEN 0 THEN 'retrieval' ELSE 'dream' END AS kind, CAST(n_nationkey % 5 + 1 AS INTEGER) AS version FROM nation"


@query("policies_for", f"WITH p AS ({_POLICIES}), s AS (SELECT 'src' || CAST(x AS VARCHAR) AS scope FROM generate_series(0, 3) t(x)) SELECT scope, kind, id, version, row_number() OVER (PARTITION BY scope, kind ORDER BY version DESC, id) AS nth FROM s JOIN p ON p.scope_id IS NULL OR p.scope_id = s.scope")
def policies_for(spark, sf):
    """For each scope the instance's policies and its own, the newest version of each kind first."""
    n = F.col("n_nationkey")
    p = fx.table(spark, sf, "nation").select(n.alias("id"), F.when(n % 3 != 0, F.concat(F.lit("src"), (n % 4).cast("string"))).alias("scope_id"), F.when(n % 2 == 0, "retrieval").otherwise("dream").alias("kind"), (n % 5 + 1).cast("int").alias("version"))
    scopes = spark.range(4).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("scope"))
    return listing.policies(p, scopes)


@query("blocked_receipts", "SELECT c_custkey AS user_id, count(m.id) AS elsewhere, count(m.id) > 0 AS blocked FROM customer LEFT JOIN memories m ON m.author_id = c_custkey AND m.subject_id IS NOT NULL AND m.subject_id <> c_custkey WHERE c_custkey % 3 = 1 GROUP BY c_custkey")
def blocked_receipts(spark, sf):
    """Erasures to be repeated, of users who are still there; those who have written of others are blocked."""
    receipts = fx.table(spark, sf, "customer").filter("c_custkey % 3 = 1").select(F.col("c_custkey").alias("user_id"))
    return lineage_sets.replayed(receipts, fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), fx.memories(spark, sf))


@query("last_admins", "SELECT c_custkey AS user_id, (SELECT count(*) FROM customer o WHERE o.c_custkey % 7 = 0 AND o.c_custkey % 5 <> 0 AND o.c_custkey <> c.c_custkey) AS others FROM customer c WHERE c_custkey % 7 = 0")
def last_admins(spark, sf):
    """For each admin how many other enabled ones there are: one count for all, less their own."""
    k = F.col("c_custkey")
    admins = fx.table(spark, sf, "customer").filter(k % 7 == 0).select(k.alias("user_id"), (k % 5 != 0).alias("enabled"))
    total = admins.agg(F.count_if("enabled").alias("n"))
    return admins.crossJoin(F.broadcast(total)).select("user_id", (F.col("n") - F.col("enabled").cast("long")).alias("others"))  # one row


@query("nameable_entities", """WITH v AS (SELECT m.user_id, e.id FROM memberships m JOIN entities e ON e.id = m.entity_id WHERE NOT e.archived AND e.kind <> 'user' UNION SELECT c_custkey, e.id FROM customer, entities e WHERE e.visibility = 'team' AND NOT e.archived AND e.kind <> 'user'),
 t AS (SELECT DISTINCT a.user_id, 'user' || CAST(b.user_id AS VARCHAR) AS id FROM memberships a JOIN memberships b ON a.entity_id = b.entity_id AND a.user_id <> b.user_id WHERE a.role = 'owner' AND b.role = 'owner') SELECT user_id, id FROM v UNION SELECT user_id, id FROM t""")
def nameable_entities(spark, sf):
    """What each user sees, and their teammates, each once."""
    from gistmill.plans.curation_queries import teammates, visible_scopes

    seen = visible_scopes(spark, sf).select("user_id", F.col("entity_id").alias("id"))
    return seen.unionAll(teammates(spark, sf).select("user_id", F.concat(F.lit("user"), F.col("mate").cast("string")))).distinct()


@query("entity_profile", f"""WITH m AS (SELECT * FROM memories WHERE {LIVE}), o AS (SELECT scope_id AS entity, 'in_scope' AS part, id, row_number() OVER (PARTITION BY scope_id ORDER BY importance DESC, updated_at DESC, id) AS nth FROM m
 UNION ALL SELECT 'user' || CAST(subject_id AS VARCHAR), 'about', id, row_number() OVER (PARTITION BY subject_id ORDER BY importance DESC, updated_at DESC, id) FROM m WHERE subject_id IS NOT NULL) SELECT entity, part, id, nth FROM o WHERE nth <= 100""")
def entity_profile(spark, sf):
    return listing.entity_profiles(fx.memories(spark, sf).filter(filters.live(fx.now())))


@query("index_payload", "SELECT id, scope_id, coalesce(CAST(subject_id AS VARCHAR), '') AS subject, author_id, kind, round(CAST(importance AS DOUBLE), 6) AS importance, round(CAST(confidence AS DOUBLE), 6) AS confidence, status, source_role, review_status, array_to_string(tags, ',') AS tags, coalesce(strftime(valid_until, '%Y-%m-%dT%H:%M:%SZ'), '') AS valid_until, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS updated_at, revision, strftime(document_date, '%Y-%m-%dT%H:%M:%SZ') AS document_date, coalesce(strftime(event_start, '%Y-%m-%dT%H:%M:%SZ'), '') AS event_start, coalesce(strftime(event_end, '%Y-%m-%dT%H:%M:%SZ'), '') AS event_end, is_static, sha256(text) AS text_sha, CASE WHEN no % 5 <> 0 THEN 'agent' || CAST(no % 3 AS VARCHAR) ELSE '' END AS agent_id, CASE WHEN no % 4 = 0 THEN '{}' ELSE '{\"lang\":\"' || lang || '\",\"source\":\"' || scope_id || '\"}' END AS context, no % 8 = 0 AS redacted FROM memories")
def index_payload(spark, sf):
    """What the index holds of a memory, as it is written there."""
    n = F.col("no")
    more = {"agent_id": F.when(n % 5 != 0, F.concat(F.lit("agent"), (n % 3).cast("string"))), "context": F.when(n % 4 != 0, F.create_map(F.lit("source"), "scope_id", F.lit("lang"), "lang")), "redacted": n % 8 == 0}
    return listing.payload(fx.memories(spark, sf).withColumns(more))


@query("raw_payload", "SELECT CAST(user_id AS VARCHAR) AS user_id, scope_id, CASE WHEN id % 5 <> 0 THEN 'agent' || CAST(id % 3 AS VARCHAR) ELSE '' END AS agent_id, session_id, role, content AS text, CASE WHEN id % 4 = 0 THEN '{}' ELSE '{\"a\":\"' || role || '\"}' END AS context, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, id AS message_id, id % 8 = 0 AS redacted FROM messages")
def raw_payload(spark, sf):
    """What the index holds of a message."""
    n = F.col("id")
    more = {"agent_id": F.when(n % 5 != 0, F.concat(F.lit("agent"), (n % 3).cast("string"))), "context": F.when(n % 4 != 0, F.create_map(F.lit("a"), "role")), "redacted": n % 8 == 0}
    return listing.raw_payload(fx.messages(spark, sf).withColumns(more))


@query("payload_parity", "WITH m AS (SELECT id, kind, revision, status FROM memories WHERE status = 'active'), x AS (SELECT id, kind, CASE WHEN no % 41 = 7 THEN revision - 1 ELSE revision END AS revision, status FROM memories WHERE status = 'active' AND no % 37 <> 5 UNION ALL SELECT 'x' || id, kind, revision, status FROM memories WHERE no % 43 = 6) SELECT 'missing' AS side, id FROM m WHERE id NOT IN (SELECT id FROM x) UNION ALL SELECT 'orphan', id FROM x WHERE id NOT IN (SELECT id FROM m) UNION ALL SELECT 'stale', m.id FROM m JOIN x ON x.id = m.id WHERE x.revision <> m.revision")
def payload_parity(spark, sf):
    m, n = fx.memories(spark, sf), F.col("no")
    live = m.filter("status = 'active'")
    held = live.filter(n % 37 != 5).select("id", "kind", F.when(n % 41 == 7, F.col("revision") - 1).otherwise(F.col("revision")).alias("revision"), "status")
    held = held.unionAll(m.filter(n % 43 == 6).select(F.concat(F.lit("x"), "id"), "kind", "revision", "status"))
    return lineage_sets.parity(live.select("id", "kind", "revision", "status"), held)


_EXPORTED = """s AS (SELECT DISTINCT session_id FROM messages WHERE user_id = 7), own AS (SELECT * FROM memories WHERE scope_id = 'src7' OR author_id = 7), held AS (SELECT * FROM evidence WHERE memory_id IN (SELECT id FROM own)), runs AS (SELECT * FROM searches WHERE user_id = 7),
 r AS (SELECT *, coalesce(text = lag(text) OVER (PARTITION BY memory_id ORDER BY revision), true) AS same FROM revisions), k AS (SELECT *, bool_and(same) OVER (PARTITION BY memory_id ORDER BY revision) AS kept FROM r)"""
_PARTS = {
    "user": "SELECT c_custkey FROM customer WHERE c_custkey = 7", "api_keys": "SELECT 1 FROM orders WHERE o_custkey = 7", "entities": "SELECT 1 FROM entities WHERE id = 'user7'", "memberships": "SELECT 1 FROM memberships WHERE user_id = 7",
    "sessions": "SELECT 1 FROM s", "messages": "SELECT 1 FROM messages WHERE user_id = 7", "memories": "SELECT 1 FROM own", "revisions": "SELECT 1 FROM revisions WHERE memory_id IN (SELECT id FROM own)",
    "sources": "SELECT DISTINCT memory_id, message_id FROM held", "evidence": "SELECT 1 FROM held", "revision_evidence": "SELECT 1 FROM k JOIN held h ON h.memory_id = k.memory_id WHERE kept",
    "relations": "SELECT 1 FROM relations WHERE from_id IN (SELECT id FROM own) AND to_id IN (SELECT id FROM own)", "attention": "SELECT 1 FROM orders WHERE o_custkey = 7 AND o_orderpriority = '1-URGENT'", "runs": "SELECT 1 FROM runs",
    "run_feedback": "SELECT 1 FROM feedback WHERE run_id IN (SELECT id FROM runs)", "feedback": "SELECT 1 FROM feedback WHERE memory_id IN (SELECT id FROM own)", "calls": "SELECT 1 FROM calls WHERE user_id = 7",
}


def _store(spark, sf):
    """The tables that an export reads; users and keys with the secrets that it leaves out."""
    orders = fx.table(spark, sf, "orders")
    named = {name: getattr(fx, name)(spark, sf) for name in ("messages", "memories", "revisions", "evidence", "relations", "memberships", "feedback", "calls", "entities")}
    return named | {
        "runs": fx.searches(spark, sf), "users": fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.sha2(F.col("c_name").cast("binary"), 256).alias("password_hash")),
        "api_keys": orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("name"), F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("key_hash")),
        "attention": orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id")), "sources": fx.evidence(spark, sf).select("memory_id", "message_id").distinct(),
    }


@query("export_counts", f"WITH {_EXPORTED} " + " UNION ALL ".join(f"SELECT '{name}' AS part, count(*) AS n FROM ({sql})" for name, sql in _PARTS.items()))
def export_counts(spark, sf):
    """How many rows each of the seventeen parts of one user's export holds."""
    parts = lineage_sets.export(_store(spark, sf), 7, "src7", "user7")
    out = None
    for name, rows in parts.items():
        n = rows.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = n if out is None else out.unionAll(n)
    return out


@query("session_conflicts", "SELECT g.id, CASE WHEN g.user_id <> f.user_id THEN 'other_user' WHEN g.agent <> f.agent THEN 'other_agent' END AS reason FROM (SELECT id, session_id, CASE WHEN id % 13 = 5 THEN user_id + 1 ELSE user_id END AS user_id, CASE WHEN id % 11 = 4 THEN 'b' ELSE 'a' END AS agent FROM messages) g JOIN (SELECT session_id, arg_min(CASE WHEN id % 13 = 5 THEN user_id + 1 ELSE user_id END, id) AS user_id, arg_min(CASE WHEN id % 11 = 4 THEN 'b' ELSE 'a' END, id) AS agent FROM messages GROUP BY session_id) f ON f.session_id = g.session_id")
def session_conflicts(spark, sf):
    """A session's first event fixes its user and agent; later ones that name others are refused."""
    g = fx.messages(spark, sf)
    events = g.select("id", "session_id", F.when(F.col("id") % 13 == 5, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"), F.when(F.col("id") % 11 == 4, "b").otherwise("a").alias("agent"))
    return curation.session_conflicts(events).select("id", "reason")


_EVENTS = """SELECT CAST(session_id % 10 AS VARCHAR) AS queue, session_id, id, false AS closes, regexp_matches(content, '(?i)remember (that|this)') OR id % 11 = 3 AS urgent FROM messages WHERE role <> 'system'
 UNION ALL SELECT DISTINCT CAST(session_id % 10 AS VARCHAR), session_id, session_id * 1000 + 999, true, false FROM messages WHERE session_id % 2 = 0"""


@query("window_jobs", f"""WITH e AS ({_EVENTS}), s AS (SELECT *, coalesce(sum(CASE WHEN closes OR urgent THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM e),
 p AS (SELECT *, (row_number() OVER (PARTITION BY session_id, seg ORDER BY id) - 1) // 4 AS sub FROM s WHERE NOT closes), g AS (SELECT queue, session_id, seg, sub, count(*) AS n, min(id) AS first_id, max(id) AS last_id, arg_max(urgent, id) AS urgent FROM p GROUP BY ALL),
 c AS (SELECT session_id, seg, id AS closed FROM s WHERE closes), w AS (SELECT g.*, closed, CASE WHEN n = 4 THEN 'full' WHEN urgent THEN 'remember' WHEN closed IS NOT NULL THEN 'closed' END AS reason FROM g LEFT JOIN c ON c.session_id = g.session_id AND c.seg = g.seg),
 d AS (SELECT *, CASE WHEN reason = 'closed' THEN closed ELSE last_id END AS done, row_number() OVER (PARTITION BY session_id ORDER BY seg, sub) - 1 AS win FROM w WHERE reason IS NOT NULL)
 SELECT queue, session_id, win, n, first_id, last_id, done, reason, (row_number() OVER (PARTITION BY queue ORDER BY done, session_id, win) - 1) // 25 AS job FROM d""")
def window_jobs(spark, sf):
    """Windows that are due: full, behind a message that asks to be remembered, or of a session that closed; in jobs of twenty-five."""
    g = fx.messages(spark, sf).withColumn("queue", (F.col("session_id") % 10).cast("string"))
    urgent = curation.urgent(F.col("content")) | (F.col("id") % 11 == 3)
    said = g.filter("role != 'system'").select("queue", "session_id", "id", F.lit(False).alias("closes"), urgent.alias("urgent"))
    closing = g.filter("session_id % 2 = 0").select("queue", "session_id", (F.col("session_id") * 1000 + 999).alias("id"), F.lit(True), F.lit(False)).distinct()
    return curation.window_jobs(said.unionAll(closing), size=4)


@query("dream_progress", "WITH c AS (SELECT scope_id, updated_at, id, no % 50 = 49 AS failed FROM memories WHERE status = 'active'), f AS (SELECT scope_id, min((updated_at, id)) AS stop FROM c WHERE failed GROUP BY scope_id) SELECT c.scope_id, max(updated_at) AS seen_at, arg_max(id, (updated_at, id)) AS id FROM c LEFT JOIN f ON f.scope_id = c.scope_id WHERE stop IS NULL OR (updated_at, id) < stop GROUP BY c.scope_id")
def dream_progress(spark, sf):
    """How far each scope is done: up to the last row before the first that failed."""
    m = fx.memories(spark, sf).filter("status = 'active'").select("scope_id", "updated_at", "id", (F.col("no") % 50 == 49).alias("failed"))
    return curation.progress(m)


@query("neighbour_budget", """WITH RECURSIVE b AS (SELECT r.from_id AS id, r.to_id AS other, CASE r.relation WHEN 'updates' THEN 0 ELSE 1 END AS part, m.text FROM relations r JOIN memories m ON m.id = r.to_id), i AS (SELECT CAST(id AS BIGINT) // 100 AS q, row_number() OVER (PARTITION BY CAST(id AS BIGINT) // 100 ORDER BY part, id, other) AS k, id, other, """ + _TOKENS.replace("text", "b.text") + """ + 6 AS cost FROM b),
 f AS (SELECT DISTINCT q, CAST(0 AS BIGINT) AS k, '' AS id, '' AS other, CAST(0 AS BIGINT) AS used, false AS took FROM i UNION ALL SELECT i.q, i.k, i.id, i.other, CASE WHEN f.used + i.cost <= 900 THEN f.used + i.cost ELSE f.used END, f.used + i.cost <= 900 FROM f JOIN i ON i.q = f.q AND i.k = f.k + 1) SELECT q, id, other, used FROM f WHERE took""")
def neighbour_budget(spark, sf):
    """What facts and sources leave of a budget goes to neighbours: what was replaced first, then what is related."""
    e = fx.relations(spark, sf).join(fx.memories(spark, sf).select(F.col("id").alias("to_id"), (text.token_count(F.col("text")) + 6).alias("cost")), "to_id")
    rows = e.select(F.floor(F.col("from_id").cast("long") / 100).alias("q"), F.when(F.col("relation") == "updates", 0).otherwise(1).alias("part"), F.col("from_id").alias("id"), F.col("to_id").alias("other"), "cost")
    return graph.within_leftover(rows, 900, "q")


_TOKEN = r'"(?:[^"\\]|\\.)*"\s*:?|[^"]+'
_SCRUBBED, _SCRUBS = text.redacted_sql("said")
_CONTEXT = """'{"note": ' || to_json(text) || ', "n_tokens": ' || CAST(no AS VARCHAR) || ', "api_key": {"x": [1, true], "password": ' || to_json(scope_id) || '}, "token" : ' || CASE no % 3 WHEN 0 THEN '""' WHEN 1 THEN 'null' ELSE to_json(lang || ' ' || text) END || ', "rows": [' || to_json('password=' || scope_id || ' and on') || ', {"Authorization": [' || to_json(kind) || ']}], "token=' || scope_id || '": 1.50}'"""


@query("redacted_context", rf"""WITH j AS (SELECT id, {_CONTEXT} AS said FROM memories), t AS (SELECT id, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM (SELECT id, regexp_extract_all(said, '{_TOKEN}') AS t FROM j)),
 k AS (SELECT *, starts_with(tok, '"') AS is_text, ends_with(tok, ':') AS is_key, regexp_replace(tok, '\s*:$', '') AS quoted, lag(tok, 1, '') OVER w AS p1, lag(tok, 2, '') OVER w AS p2 FROM t WINDOW w AS (PARTITION BY id ORDER BY pos)),
 v AS (SELECT *, json_extract_string(CASE WHEN is_text THEN quoted ELSE '0' END, '$') AS said, CASE WHEN trim(p1) = '' THEN p2 ELSE p1 END AS name FROM k), h AS (SELECT *, is_text AND NOT is_key AND said <> '' AND name LIKE '"%:' AND regexp_matches(name, '{text.SENSITIVE_KEY}') AS hidden FROM v),
 c AS (SELECT *, CASE WHEN NOT is_text THEN 0 WHEN hidden THEN 1 ELSE {_SCRUBS} END AS n FROM h)
 SELECT id, string_agg(CASE WHEN hidden THEN '"[REDACTED]"' WHEN n > 0 THEN CAST(to_json({_SCRUBBED}) AS VARCHAR) || substr(tok, length(quoted) + 1) ELSE tok END, '' ORDER BY pos) AS context, CAST(sum(n) AS INTEGER) AS n FROM c GROUP BY id""")
def redacted_context(spark, sf):
    """JSON of any shape with texts as they come: strings that are not empty go under sensitive keys, other strings are redacted, keys too, at any depth."""
    m = fx.memories(spark, sf)
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    token = F.when(F.col("no") % 3 == 0, '""').when(F.col("no") % 3 == 1, "null").otherwise(quoted(F.concat("lang", F.lit(" "), "text")))
    parts = [
        F.lit('{"note": '), quoted(F.col("text")), F.lit(', "n_tokens": '), F.col("no").cast("string"), F.lit(', "api_key": {"x": [1, true], "password": '), quoted(F.col("scope_id")), F.lit('}, "token" : '), token,
        F.lit(', "rows": ['), quoted(F.concat(F.lit("password="), "scope_id", F.lit(" and on"))), F.lit(', {"Authorization": ['), quoted(F.col("kind")), F.lit(']}], "token='), F.col("scope_id"), F.lit('": 1.50}'),
    ]
    return m.select("id", text.redact_json(F.concat(*parts)).alias("x")).select("id", F.col("x.json").alias("context"), F.col("x.count").alias("n"))


@query("session_lines", "SELECT session_id, string_agg('[' || CAST(id AS VARCHAR) || '] ' || role || ': ' || CASE WHEN role = 'assistant' AND length(content) > 220 THEN regexp_replace(substr(content, 1, 220), '\\s+$', '') || ' […truncated]' ELSE content END, chr(10) ORDER BY turn) AS lines FROM messages GROUP BY session_id")
def session_lines(spark, sf):
    """A session as a prompt shows it: turns in order, long ones of the assistant cut."""
    said = F.when(F.col("role") == "assistant", text.shortened(F.col("content"))).otherwise(F.col("content"))
    g = fx.messages(spark, sf).select("session_id", F.struct("turn", F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.col("role"), F.lit(": "), said).alias("line")).alias("x"))
    lines = g.groupBy("session_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lines.select("session_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("lines"))


@query("context_compact", """WITH RECURSIVE r AS (SELECT no // 40 AS q, no % 40 AS rank, id, list_filter([CASE WHEN no % 3 = 0 THEN lpad(CAST(no - 1 AS VARCHAR), 8, '0') END, CASE WHEN no % 5 = 0 THEN lpad(CAST(no - 2 AS VARCHAR), 8, '0') END], lambda x: x IS NOT NULL) AS dups FROM memories),
 f AS (SELECT DISTINCT q, CAST(-1 AS BIGINT) AS rank, CAST([] AS VARCHAR[]) AS kept FROM r UNION ALL SELECT f.q, r.rank, CASE WHEN list_has_any(f.kept, r.dups) THEN f.kept ELSE list_append(f.kept, r.id) END FROM f JOIN r ON r.q = f.q AND r.rank = f.rank + 1)
 SELECT q, CAST(generate_subscripts(kept, 1) - 1 AS INTEGER) AS place, unnest(kept) AS id FROM (SELECT q, arg_max(kept, rank) AS kept FROM f GROUP BY q)""")
def context_compact(spark, sf):
    """Lists in order, without rows that a judgment calls redundant to one kept before."""
    from gistmill.operators import profiles

    m, n = fx.memories(spark, sf).select("no", "id"), F.col("no")
    back = lambda every, k: m.filter(n % every == 0).select("id", F.lpad((n - k).cast("string"), 8, "0").alias("earlier"))
    return profiles.unrepeated(m.select(F.floor(n / 40).alias("q"), (n % 40).alias("rank"), "id"), back(3, 1).unionAll(back(5, 2)), "q")


_END = r"(?:\n\s*\n|[.!?]\s+)"


@query("text_passages", rf"""WITH RECURSIVE p AS (SELECT id, text, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS n FROM memories WHERE text IS NOT NULL
 UNION ALL SELECT id, text, b, to_, n + CASE WHEN regexp_matches(substr(text, CAST(b AS INTEGER) + 1, CAST(to_ - b AS INTEGER)), '\S') THEN 1 ELSE 0 END
 FROM (SELECT *, CASE WHEN b + 1200 >= length(text) THEN length(text) WHEN near > 0 THEN b + near WHEN far > 0 THEN b + 1200 + far END AS to_
  FROM (SELECT *, length(regexp_extract(substr(text, CAST(b AS INTEGER) + 1, 1200), '(?s)^.*{_END}')) AS near, length(regexp_extract(substr(text, CAST(b AS INTEGER) + 1201, 1200), '(?s)^.*?{_END}')) AS far FROM p WHERE b < length(text) AND n < 8)) WHERE to_ IS NOT NULL),
 s AS (SELECT id, a, b FROM p WHERE b > a AND regexp_matches(substr(text, CAST(a AS INTEGER) + 1, CAST(b - a AS INTEGER)), '\S'))
 SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY a) - 1 AS INTEGER) AS nth, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end" FROM s""")
def text_passages(spark, sf):
    """Verbatim passages of each memory's text."""
    from gistmill.functions import passages

    each = fx.memories(spark, sf).select("id", F.posexplode(passages.passages("text")).alias("nth", "p"))
    return each.select("id", "nth", F.col("p.start").alias("start"), F.col("p.end").alias("end"))


@query("cited_surroundings", """WITH c AS (SELECT memory_id, message_id, content, CAST(memory_id AS BIGINT) % 3 * 80 AS size, CAST((CAST(memory_id AS BIGINT) * 13) % (length(content) + 1) AS INTEGER) AS a FROM evidence e JOIN messages g ON g.id = e.message_id),
 d AS (SELECT *, least(a + 20, length(content)) AS b, greatest(0, size - (least(a + 20, length(content)) - a)) // 2 AS extra FROM c), w AS (SELECT *, greatest(0, a - extra) AS lo, least(length(content), b + extra) AS hi FROM d),
 g AS (SELECT *, strpos(substr(content, CAST(lo AS INTEGER) + 1, CAST(a - lo AS INTEGER)), ' ') AS gap, length(regexp_extract(substr(content, CAST(b AS INTEGER) + 1, CAST(hi - b AS INTEGER)), '(?s)^.* ')) AS last FROM w),
 z AS (SELECT *, size <= 0 OR (a = 0 AND b >= length(content)) AS whole FROM g),
 y AS (SELECT *, CASE WHEN whole THEN a WHEN lo > 0 AND gap > 0 THEN lo + gap ELSE lo END AS low, CASE WHEN whole THEN b WHEN hi < length(content) AND last > 0 THEN b + last - 1 ELSE hi END AS high FROM z)
 SELECT memory_id, message_id, CAST(low AS INTEGER) AS low, CAST(high AS INTEGER) AS high, substr(content, CAST(low AS INTEGER) + 1, CAST(high - low AS INTEGER)) AS around FROM y""")
def cited_surroundings(spark, sf):
    """What stands around each citation, wherever it lies in its message, cut between words; windows of three sizes."""
    g = fx.messages(spark, sf).select(F.col("id").alias("message_id"), "content")
    n = F.col("memory_id").cast("long")
    e = fx.evidence(spark, sf).join(g, "message_id").withColumn("a", ((n * 13) % (F.length("content") + 1)).cast("int")).withColumn("size", (n % 3 * 80).cast("int"))
    w = text.window(F.col("content"), F.col("a"), F.least(F.col("a") + 20, F.length("content")), F.col("size"))
    e = e.withColumn("w", w)
    return e.select("memory_id", "message_id", F.col("w.low").alias("low"), F.col("w.high").alias("high"), text.span(F.col("content"), F.col("w.low"), F.col("w.high")).alias("around"))


@query("candidate_lines", f"""SELECT scope_id, string_agg('- id=' || id || ' kind=' || kind || ' said=' || strftime(document_date, '%Y-%m-%d') || CASE WHEN event_start IS NOT NULL THEN ' events=' || strftime(event_start, '%Y-%m-%d') || ',' || strftime(event_end, '%Y-%m-%d') ELSE '' END
 || ' context=' || CASE WHEN no % 2 = 0 THEN '{{' || chr(39) || 'lang' || chr(39) || ': ' || chr(39) || lang || chr(39) || '}}' ELSE '{{}}' END || ' importance=' || CAST(importance AS VARCHAR) || ': ' || text, chr(10) ORDER BY id) AS lines FROM memories WHERE {IN_SCOPES} GROUP BY scope_id""")
def candidate_lines(spark, sf):
    """Candidates as a prompt lists them, with when each was said."""
    m = fx.memories(spark, sf).filter(F.col("scope_id").isin(SCOPES))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    events = F.when(F.col("event_start").isNotNull(), F.array(day("event_start"), day("event_end")))
    context = F.when(F.col("no") % 2 == 0, F.create_map(F.lit("lang"), F.col("lang")))
    line = rendering.candidate(F.col("id"), F.col("kind"), F.col("document_date"), events, context, F.col("importance"), F.col("text"))
    return rendering.lines(m.select("scope_id", "id", line.alias("line")), "scope_id", "id")


@query("entity_lines", """WITH e AS (SELECT user_id, entity_id, row_number() OVER (PARTITION BY user_id ORDER BY entity_id) AS ref FROM (SELECT DISTINCT user_id, entity_id FROM memberships))
 SELECT user_id, string_agg(CAST(ref AS VARCHAR) || '. project: ' || entity_id || CASE WHEN ref % 2 = 1 THEN ' — aliases: ' || upper(entity_id) || ', the ' || entity_id ELSE '' END, chr(10) ORDER BY ref) AS lines FROM e GROUP BY user_id""")
def entity_lines(spark, sf):
    """The entities that a speaker may mean, numbered, with the names that people say."""
    from pyspark.sql import Window

    e = fx.memberships(spark, sf).select("user_id", "entity_id").distinct().withColumn("ref", F.row_number().over(Window.partitionBy("user_id").orderBy("entity_id")))
    names = F.when(F.col("ref") % 2 == 1, F.array(F.upper("entity_id"), F.concat(F.lit("the "), "entity_id")))
    return rendering.lines(e.select("user_id", "ref", rendering.entity(F.col("ref"), F.lit("project"), F.col("entity_id"), names).alias("line")), "user_id", "ref")


@query("user_patches", f"SELECT c_custkey AS user_id, CASE WHEN c_custkey % 6 = 0 THEN trim('  Name ' || c_name) ELSE c_name END AS display_name, CASE WHEN c_custkey % 5 = 1 THEN 'admin' ELSE 'member' END AS role, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2023-01-01' ELSE {NOW} END WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2023-01-01' END AS disabled_at FROM customer")
def user_patches(spark, sf):
    """Patches of users: what one says nothing on stays; the first moment of being disabled stays, too."""
    k = F.col("c_custkey")
    users = fx.table(spark, sf, "customer").select(k.alias("user_id"), F.col("c_name").alias("display_name"), F.lit("member").alias("role"), F.when(k % 3 == 0, F.lit("2023-01-01").cast("timestamp")).alias("disabled_at"))
    patches = fx.table(spark, sf, "customer").select(
        k.alias("user_id"), F.when(k % 6 == 0, F.concat(F.lit("  Name "), "c_name")).when(k % 6 == 1, "").alias("display_name"), F.when(k % 5 == 1, "admin").alias("role"), F.when(k % 4 == 0, F.lit(False)).when(k % 4 == 1, F.lit(True)).alias("disabled"),
    )
    return writes.patched_users(users, patches, fx.now())


_CLIENT, _CLIENT_N = text.redacted_sql("text", text.CLIENT_SECRETS)


@query("client_scrub", f"SELECT id, {_CLIENT} AS clean, CAST({_CLIENT_N} AS INTEGER) AS n FROM memories")
def client_scrub(spark, sf):
    """What a client takes out of a text before it sends it."""
    said = F.col("text")
    return fx.memories(spark, sf).select("id", text.redact(said, text.CLIENT_SECRETS).alias("clean"), text.redactions(said, text.CLIENT_SECRETS).cast("int").alias("n"))


_LINE = "SELECT id, CASE WHEN id % 23 = 4 THEN NULL WHEN id % 19 = 3 THEN 'summary' ELSE role END AS kind, id % 13 = 5 AS side, id % 17 = 3 AS meta, id % 11 = 6 AS tool, CASE WHEN id % 29 = 1 THEN '<system-reminder> ' || content WHEN id % 31 = 2 THEN '[Request interrupted by user]' WHEN id % 37 = 3 THEN ' ' WHEN id % 41 = 5 THEN repeat('x ', 10001) ELSE content END AS said, CASE WHEN id % 7 = 2 THEN 'system' WHEN id % 7 = 3 THEN 'typed' END AS source, CASE WHEN id % 43 <> 7 THEN CAST(id AS VARCHAR) END AS uuid FROM messages"


_TURNS = f"""l AS ({_LINE}), t AS (SELECT *, {text.stripped_sql('said')} AS body FROM l), turns AS (SELECT id, coalesce(reason, CASE WHEN kind = 'user' THEN 'user:' || coalesce(source, 'n/a') ELSE 'assistant' END) AS reason, reason IS NULL AS kept, coalesce(reason IS NULL AND kind = 'user' AND length(body) >= 20, false) AS indexed FROM (SELECT *, CASE WHEN id % 47 = 9 THEN 'bad-json' WHEN kind IS NULL OR kind NOT IN ('user', 'assistant') THEN 'type:' || coalesce(kind, 'None')
 WHEN side THEN 'sidechain' WHEN meta THEN 'meta' WHEN tool THEN 'tool_result' WHEN body = '' THEN 'no-text' WHEN length(body) > 20000 THEN 'oversized-document' WHEN kind = 'user' AND source = 'system' THEN 'source:system' WHEN kind = 'user' AND starts_with(body, '[Request interrupted') THEN 'interrupt-marker'
 WHEN kind = 'user' AND starts_with(body, '<system-reminder>') THEN 'system-reminder' WHEN uuid IS NULL THEN 'missing-ids' END AS reason FROM t))"""


@query("transcript_turns", f"WITH {_TURNS} SELECT * FROM turns")
def transcript_turns(spark, sf):
    """Lines of a transcript as JSON, each a turn or refused for the first reason that holds."""
    return transcripts.classified(_transcript(spark, sf), keep="id").select("id", "reason", "kept", "indexed")


@query("transcript_counts", f"WITH {_TURNS} SELECT kept, reason, count(*) AS n FROM turns GROUP BY ALL")
def transcript_counts(spark, sf):
    return transcripts.counts(transcripts.classified(_transcript(spark, sf)))


def _transcript(spark, sf):
    n, content = F.col("id"), F.col("content")
    said = F.when(n % 29 == 1, F.concat(F.lit("<system-reminder> "), content)).when(n % 31 == 2, "[Request interrupted by user]").when(n % 37 == 3, " ").when(n % 41 == 5, F.repeat(F.lit("x "), 10001)).otherwise(content)
    block = F.array(F.struct(F.when(n % 11 == 6, "tool_result").otherwise("text").alias("type"), said.alias("text")))
    kind = F.when(n % 23 == 4, F.lit(None)).when(n % 19 == 3, "summary").otherwise(F.col("role"))
    message = lambda body: F.to_json(F.struct(kind.alias("type"), (n % 13 == 5).alias("isSidechain"), (n % 17 == 3).alias("isMeta"), F.when(n % 7 == 2, "system").when(n % 7 == 3, "typed").alias("promptSource"), F.when(n % 43 != 7, n.cast("string")).alias("uuid"), F.col("session_id").cast("string").alias("sessionId"), F.struct(body.alias("content")).alias("message")))
    # bodies are plain strings and lists of blocks in turn
    line = F.when(n % 47 == 9, "{no json").when((n % 2 == 0) & (n % 11 != 6), message(said)).otherwise(message(block))
    return fx.messages(spark, sf).select("id", line.alias("value"))
