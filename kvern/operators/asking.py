"""Questions about one company: topics to families of facts, fixed questions to answers, gaps told as gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvern.functions import money
from kvern.operators.ranking import top

#: Topics, the words that raise them, and the families of facts they need.
TOPICS = {
    "financials": (r"financ|account|revenue|income|profit|result|debt|asset|equity|regnskap|omsetning|numbers", ("financials", "filing_history")),
    "leadership": (r"lead|role|ceo|board|chair|director|manage|leder|styre|runs", ("leadership",)),
    "locations": (r"location|where|subunit|office|workplace|address|operat", ("locations",)),
    "hiring": (r"hir|job|vacanc|career|stilling|recruit|working", ("hiring",)),
    "activity": (r"news|activ|publication|announc|nyhet", ("activity",)),
    "online": (r"web|site|social|contact|email|phone|linkedin|facebook", ("website", "contact", "social_profiles", "description")),
    "identity": (
        r"industry|purpose|describ|employee|founded|legal form|registered|what (?:does|do) (?:it|they|the company|this company) do|about (?:it|the company|this company)",
        ("identity", "description", "workforce"),
    ),
}
ABSTAIN = ("sentiment", "glassdoor", "review", "buzz", "traffic", "fraud")


def topics_of(question: Column) -> Column:
    """Topics that a question raises, in the order above; all where it raises none; none where it asks for what no source holds."""
    asked = F.lower(question)
    raised = F.filter(F.array(*[F.when(asked.rlike(words), F.lit(name)) for name, (words, _) in TOPICS.items()]), lambda t: t.isNotNull())
    every = F.array(*map(F.lit, TOPICS))
    barred = asked.rlike("|".join(ABSTAIN))
    return F.when(barred, F.array().cast("array<string>")).when(F.size(raised) > 0, raised).otherwise(every)


def families_of(topics: Column) -> Column:
    """Families of all topics, each once, sorted."""
    pairs = F.create_map(*[x for name, (_, fams) in TOPICS.items() for x in (F.lit(name), F.array(*map(F.lit, fams)))])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(topics, lambda t: F.try_element_at(pairs, t)))))


def ask(facts: DataFrame, questions: DataFrame) -> DataFrame:
    """``(question, entity, ...)`` with the facts' own columns: facts of the families that a question needs.

    ``questions (question, entity)``; ``facts (entity, family, ...)``.  A company that
    the store doesn't know, and a question for what no source holds, give no rows.
    """
    wanted = questions.select("question", "entity", F.explode(families_of(topics_of(F.col("question")))).alias("family"))
    return wanted.join(facts, ["entity", "family"]).select("question", *facts.columns)


def gaps(state: DataFrame, questions: DataFrame) -> DataFrame:
    """``(question, entity, family, state)``: families that a question needs and that are not available."""
    wanted = questions.select("question", "entity", F.explode(families_of(topics_of(F.col("question")))).alias("family"))
    return wanted.join(state.where("state <> 'available'"), ["entity", "family"]).select("question", "entity", "family", "state")


def standard_answers(facts: DataFrame) -> DataFrame:
    """``(entity, ordinal, question, answerable, answer)``: a fixed list of questions for every entity.

    Made by one conditional aggregation over live facts; a missing value is told as
    unknown, never as zero.
    """
    one = lambda field: F.min(F.when(F.col("field") == field, F.col("value")))
    text = lambda c: F.get_json_object(c, "$")
    many = lambda field: F.count_if(F.col("field") == field)
    wide = facts.where("NOT stale").groupBy("entity").agg(
        text(one("business_description")).alias("what"),
        many("registered_role").alias("roles"),
        F.get_json_object(one("registered_address"), "$.poststed").alias("place"),
        many("registered_workplace").alias("workplaces"),
        F.max(F.when(F.col("field") == "financial_revenue", F.struct(F.split("key", ":")[1].alias("until"), F.get_json_object("value", "$.amount").alias("amount")))).alias("sales"),
        many("job_posting").alias("jobs"),
        text(one("official_website")).alias("site"),
        text(one("employees")).alias("staff"),
    )
    said = [
        ("What does the company do?", F.col("what")),
        ("Who leads the company?", F.when(F.col("roles") > 0, F.concat(F.col("roles"), F.lit(" registered roles")))),
        ("Where does it operate?", F.when(F.col("place").isNotNull(), F.concat("place", F.lit(", "), F.col("workplaces"), F.lit(" workplaces")))),
        ("What are its latest filed numbers?", F.concat(F.lit("revenue "), money.whole_units(money.amount(F.col("sales.amount"))))),
        ("Is it hiring?", F.when(F.col("jobs") > 0, F.concat(F.col("jobs"), F.lit(" open ads")))),
        ("Does it have a verified website?", F.col("site")),
        ("How many people does it employ?", F.col("staff")),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(q).alias("question"), a.cast("string").alias("answer")) for i, (q, a) in enumerate(said, 1)])
    each = wide.select("entity", F.explode(rows).alias("r")).select("entity", "r.*")
    return each.select("entity", "ordinal", "question", F.col("answer").isNotNull().alias("answerable"), F.coalesce("answer", F.lit("unknown")).alias("answer"))


def brief(answers: DataFrame) -> DataFrame:
    """``(entity, brief)``: the answered questions' answers as one text, in order."""
    known = answers.where("answerable").groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("ordinal", "answer"))).alias("a"))
    return known.select("entity", F.array_join(F.transform("a", lambda x: x["answer"]), ". ").alias("brief"))


def newest(facts: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest dated facts of each entity."""
    dated = facts.where("effective_at IS NOT NULL")
    return top(dated, ["entity"], [F.col("effective_at").desc(), F.col("id")], n)
