"""What a release is made of: its input, tuples, figures and reports, as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .release import any_state, decision_shares
from .review import published_decisions

#: Words that claim too much, kinds of relations, and how many words a qualification may have if it names a clause.
BANNED = ["satisfies", "fulfils", "fulfills"]
RELATION_TYPES = ["addresses", "supports", "partial"]
QUALIFICATION_WORDS = 15


def release_input(published: DataFrame, effective: DataFrame, projects: DataFrame, publishable: DataFrame, decision_of: DataFrame, pages: DataFrame, letters: dict[str, str]) -> DataFrame:
    """(project, decisions, source_types, provider_only): the stores of a review as one row for each project.

    A published state counts if its check may be published, or if someone decided on it. `decisions` has a letter for each decision in
    order of its name; source types are those of the pages that confirmed positives of publishable checks cite (`pages`: project, span_id, url,
    source_type, visibility); `provider_only` tells that all of these came from a provider.
    """
    allowed = publishable.withColumn("ok", F.lit(True))
    counted = published.join(allowed, "check_id", "left").where(F.col("ok") | ~F.col("basis").isin("unconfirmed", "stale"))
    status = published_decisions(counted.drop("ok"), projects, publishable, decision_of)
    letter = reduce(lambda out, x: F.when(F.col("status") == x[0], x[1]).otherwise(out), letters.items(), F.lit("?"))
    decided = status.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("decision", letter.alias("l")))), lambda x: x["l"]), "").alias("decisions"))
    positive = counted.where(F.col("ok") & F.col("published").isin("pass", "claimed")).select("project", "check_id")
    cited = effective.join(positive, ["project", "check_id"], "left_semi").select("project", F.explode("span_ids").alias("span_id")).distinct()
    types = cited.join(pages, ["project", "span_id"]).groupBy("project").agg(F.array_sort(F.collect_set("source_type")).alias("source_types"), F.bool_and(F.col("visibility") == "provider").alias("provider_only"))
    joined = projects.select("project").join(decided, "project", "left").join(types, "project", "left")
    return joined.select("project", "decisions", F.coalesce("source_types", F.array().cast("array<string>")).alias("source_types"), F.coalesce("provider_only", F.lit(False)).alias("provider_only"))


def model_tuples(states: DataFrame, gated: DataFrame, projects: DataFrame, published: DataFrame, h1: list[str], h3: list[str]) -> DataFrame:
    """(tuple_id, n, c) of a release besides its check shares.

    Decisions by partition, both share hypotheses, the same without the projects whose collection `failed`, source types, and what
    confirmation changed in all and by check.
    """
    kept = projects.where("NOT failed")
    decisions = decision_shares(gated, projects).select(F.concat_ws("|", F.lit("dec"), "decision", "partition").alias("tuple_id"), "n", "c")
    shares = [any_state(states, d, checks, [state]).select(F.lit(name).alias("tuple_id"), "n", "c") for name, d, checks, state in (
        ("h1|all", projects, h1, "claimed"), ("h3|all", projects, h3, "pass"), ("sens|h1|all", kept, h1, "claimed"), ("sens|h3|all", kept, h3, "pass"),
    )]
    without = gated.join(kept.select("project"), "project", "left_semi").groupBy("decision").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "PASS").alias("c"))
    sizes = projects.agg(F.count("*").alias("n"))
    sources = projects.select("project", "source").distinct().groupBy("source").agg(F.count("*").alias("c")).crossJoin(F.broadcast(sizes))  # one row
    decided = published.join(projects.select("project"), "project", "left_semi").where(F.col("basis").isin("confirmed", "downgraded", "rejected"))
    changed = F.count_if(F.col("basis") != "confirmed").alias("c")
    by_check = decided.groupBy("check_id").agg(F.count("*").alias("n"), changed)
    kinds = decided.agg(F.count("*").alias("n"), F.count_if(F.col("basis") == "rejected").alias("r"), F.count_if(F.col("basis") == "downgraded").alias("d"))
    split = kinds.select("n", F.explode(F.array(F.struct(F.lit("conf|rejected").alias("tuple_id"), F.col("r").alias("c")), F.struct(F.lit("conf|downgraded").alias("tuple_id"), F.col("d").alias("c")))).alias("k"))
    parts = [
        decisions, *shares, without.select(F.concat(F.lit("sens|dec|"), "decision", F.lit("|all")).alias("tuple_id"), "n", "c"), sources.select(F.concat(F.lit("st|"), "source", F.lit("|all")).alias("tuple_id"), "n", "c"),
        by_check.select(F.concat(F.lit("conf|chk|"), "check_id").alias("tuple_id"), "n", "c"), split.select("k.tuple_id", "n", "k.c"),
    ]
    return reduce(DataFrame.unionByName, parts)


def figure_rows(checks: DataFrame, partitions: DataFrame) -> DataFrame:
    """(figure, ordinal, tuple_id) of a release's figures, from checks (check_id, ordinal, decision) and partitions (partition, kind, ordinal).

    Each decision has its checks over all, and its own shares by cohort and by source; then come all decisions, claims beside passes, and
    every check and state by cohort and by source.
    """
    order = lambda *cols: F.array(*(F.col(c) if isinstance(c, str) else c for c in cols))
    decisions = checks.groupBy("decision").agg(F.min("ordinal").alias("ordinal"))
    named = F.transform(F.array(F.lit("claimed"), F.lit("pass")), lambda s: s)
    by_state = checks.select("check_id", "ordinal", F.posexplode(named).alias("s", "state"))
    groups = partitions.where("kind <> 'all'")
    one = checks.select(F.concat(F.lit("checks:"), "decision").alias("figure"), order("ordinal").alias("at"), F.concat_ws("|", F.lit("chk"), "check_id", F.lit("pass"), F.lit("all")).alias("tuple_id"))
    all_of = decisions.select(F.lit("decisions").alias("figure"), order("ordinal").alias("at"), F.concat_ws("|", F.lit("dec"), "decision", F.lit("all")).alias("tuple_id"))
    each = decisions.drop("ordinal").crossJoin(F.broadcast(groups))  # decisions x partitions: tens of rows
    each = each.select(F.concat(F.when(F.col("kind") == "cohort", "cohorts:").otherwise("sources:"), "decision").alias("figure"), order("ordinal").alias("at"), F.concat_ws("|", F.lit("dec"), "decision", "partition").alias("tuple_id"))
    claims = by_state.select(F.lit("claims").alias("figure"), order("ordinal", "s").alias("at"), F.concat_ws("|", F.lit("chk"), "check_id", "state", F.lit("all")).alias("tuple_id"))
    many = by_state.crossJoin(F.broadcast(groups.select("partition", "kind", F.col("ordinal").alias("p"))))
    many = many.select(F.when(F.col("kind") == "cohort", "checksByCohort").otherwise("checksBySource").alias("figure"), order("ordinal", -F.col("s"), "p").alias("at"), F.concat_ws("|", F.lit("chk"), "check_id", "state", "partition").alias("tuple_id"))
    rows = reduce(DataFrame.unionByName, [one, all_of, each, claims, many])
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("figure").orderBy("at"))  # a figure is tens of rows
    return rows.select("figure", place.cast("long").alias("ordinal"), "tuple_id")


def gap_texts(checks: DataFrame, entries: DataFrame, approved: Column) -> DataFrame:
    """(check_id, text, source): the gap text if it is approved and there, else the check's pass rule."""
    own = entries.where(approved).select("check_id", F.col("text").alias("gap"))
    joined = checks.join(own, "check_id", "left")
    return joined.select("check_id", F.coalesce("gap", "pass_rule").alias("text"), F.when(F.col("gap").isNotNull(), "gap-text").otherwise("passRule").alias("source"))


def report_views(published: DataFrame, cites: DataFrame, spans: DataFrame, gaps: DataFrame) -> DataFrame:
    """(project, checks): one row for each project with its checks in order, each with its published state, quotes and gap text.

    `cites` (project, check_id, span_id) name what a check quotes, `spans` (project, span_id, text, url, flagged) its source. A check that
    passes has no gap.
    """
    quoted = cites.join(spans, ["project", "span_id"]).groupBy("project", "check_id").agg(F.array_sort(F.collect_list(F.struct("span_id", "text", "url", "flagged"))).alias("quotes"))
    joined = published.join(quoted, ["project", "check_id"], "left").join(gaps, "check_id", "left")
    gap = F.when(~F.col("published").eqNullSafe(F.lit("pass")), F.col("text")).alias("gap_text")
    quotes = F.coalesce("quotes", F.array().cast(quoted.schema["quotes"].dataType)).alias("quotes")
    return joined.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("check_id", "published", "basis", quotes, gap))).alias("checks"))


def method_view(gate: DataFrame, figures: DataFrame, statements: DataFrame) -> DataFrame:
    """(check_id, status, publishable, n_figures, statement): how a check is shown: its gate status, the figures it is in, and its wording."""
    shown = figures.select(F.col("figure"), F.split("tuple_id", r"\|")[1].alias("check_id")).where(F.col("tuple_id").startswith("chk|")).distinct()
    counts = shown.groupBy("check_id").agg(F.count("*").alias("n_figures"))
    joined = gate.join(counts, "check_id", "left").join(statements, "check_id", "left")
    from .review import PUBLISHABLE

    return joined.select("check_id", "status", F.col("status").isin(PUBLISHABLE).alias("publishable"), F.coalesce("n_figures", F.lit(0)).cast("long").alias("n_figures"), "statement")


def dictionary_terms(views: DataFrame, platforms: list[str]) -> DataFrame:
    """(project, term, placeholder): what identifies a project: its title, and hosts or repositories of its addresses, each with its variants.

    Views are (project, title, urls). A term of several parts also comes joined by blanks, hyphens, underscores and nothing. Terms under three
    characters are left out; of equal ones in a project, whatever their case, the first kind counts: product, repository, domain.
    """
    from ..functions.text import host, path, registrable

    titles = views.where("title IS NOT NULL").select("project", F.col("title").alias("t"), F.lit(0).alias("o"), F.lit("[product]").alias("placeholder"))
    urls = views.select("project", F.explode("urls").alias("url")).select("project", F.regexp_replace(host(F.col("url")), r"^www\.", "").alias("h"), F.filter(F.split(path(F.col("url")), "/"), lambda x: x != "").alias("segs"))
    hosted = F.col("h").isin(platforms)
    repos = urls.where(hosted).select("project", F.explode(F.transform(F.slice("segs", 1, 2), lambda x: F.regexp_replace(x, r"\.git$", ""))).alias("t"), F.lit(1).alias("o"), F.lit("[repo]").alias("placeholder"))
    name = registrable(F.col("h"))
    domains = urls.where(~hosted & (F.col("h") != "")).select("project", F.explode(F.array("h", name, F.substring_index(name, ".", 1))).alias("t"), F.lit(2).alias("o"), F.lit("[domain]").alias("placeholder"))
    every = titles.unionByName(repos).unionByName(domains)
    parts = F.filter(F.split(F.trim("t"), r"[\s_-]+|(?<=[a-z])(?=[A-Z])"), lambda x: x != "")
    forms = F.when(F.size(parts) < 2, F.array(F.trim("t"))).otherwise(F.array(F.trim("t"), *(F.array_join(parts, s) for s in (" ", "-", "_", ""))))
    each = every.select("project", "o", "placeholder", F.posexplode(forms).alias("i", "term")).where(F.length("term") >= 3)
    first = each.groupBy("project", F.lower("term").alias("low")).agg(F.min(F.struct("o", "i", "term", "placeholder")).alias("r"))
    return first.select("project", "r.term", "r.placeholder")


def codebook_faults(entries: DataFrame, wanted: DataFrame, edges: DataFrame, standards: list[str], clauses: list[str], also_banned: list[str] = ()) -> DataFrame:
    """(at, problem): what is wrong with a codebook.

    `entries` (check_id, field, value) hold its texts, `edges` (check_id, standard, relation, qualification) its crosswalk. Checks must be those `wanted`,
    texts filled in and free of words that claim too much, every standard crossed by a relation of a known kind, and long qualifications may not
    quote a clause. `also_banned` adds words to the fixed ones.
    """
    have, want = entries.select("check_id").distinct(), wanted.select("check_id").distinct()
    out = lambda d, at, problem: d.select(at.alias("at"), F.lit(problem).alias("problem"))
    names = F.array(*(F.lit(s) for s in standards))
    needed = have.select("check_id", F.explode(names).alias("standard"))
    banned = lambda c: F.exists(F.array(*(F.lit(w.lower()) for w in [*BANNED, *also_banned])), lambda w: F.contains(F.lower(c), w))
    words = F.size(F.filter(F.split(F.trim("qualification"), r"\s+"), lambda x: x != ""))
    quoting = F.exists(F.array(*(F.lit(c.lower()) for c in clauses)), lambda c: F.contains(F.lower("qualification"), c))
    edge = F.concat_ws(".", "check_id", "standard")
    return reduce(DataFrame.unionByName, [
        out(want.join(have, "check_id", "left_anti"), F.col("check_id"), "missing check"), out(have.join(want, "check_id", "left_anti"), F.col("check_id"), "extra check"),
        out(entries.where(F.coalesce(F.trim("value"), F.lit("")) == ""), F.concat_ws(".", "check_id", "field"), "empty text"),
        out(entries.where(banned(F.col("value"))), F.concat_ws(".", "check_id", "field"), "word that claims too much"),
        out(edges.where(banned(F.col("qualification"))), edge, "word that claims too much"),
        out(needed.join(edges, ["check_id", "standard"], "left_anti"), edge, "standard not crossed"), out(edges.where(~F.col("standard").isin(standards)), edge, "extra standard"),
        out(edges.where((words > QUALIFICATION_WORDS) & quoting), edge, "quotes a clause"), out(edges.where(~F.coalesce(F.col("relation").isin(RELATION_TYPES), F.lit(False))), edge, "unknown relation"),
    ])
