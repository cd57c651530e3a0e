"""New test cases from text: questions and answers, definitions, cloze tests, personas, quotas and suite rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.store import keep

#: Noise in a question or answer.
NOISE = (
    r"^what is what\??", r"^what is if\b", r"^what is it\b", r"^what is there\b", r"^what is this\b", r"^what is that\b", r"^what is several\b",
    r"(navigation|index|next|previous|theme|auto|light|dark|menu|home)", r"^(click|press|select|choose|see|explain\s+\w+\s+in\s+the\s+context)",
    r"^\d+$", r"^[\W\s]+$", r"^(documentation|general)", r"\n", r"advertising",
)
#: Subjects of definitions that say nothing.
GENERIC_SUBJECTS = ("this", "it", "there", "here", "that", "these", "those", "the page", "the section", "the following", "this page", "if", "if a", "several", "what", "it is")
#: Words never blanked out.
CLOZE_STOP = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "must", "can", "this", "that", "these", "those", "it", "its", "for", "with", "to",
    "of", "in", "on", "at", "by", "from", "up", "about", "into", "over", "after", "and", "but", "or", "if", "then", "so", "as",
)
#: How questions of a family begin, and how many sentences an answer has at most.
OPENINGS = (
    (r"What (?:is|are|does|do)", 1),
    (r"How (?:to|do|does|can)", 2),
    (r"Why (?:is|are|do|does|should|would|can)", 2),
    (r"When (?:should|do|does|is|are|to)", 2),
    (r"Which", 1),
)
#: Marks of a question and of its answer.
ASKED, TOLD = r"(?:Q|Question)[:\s]", r"(?:A|Answer)[:\s]"
_SENTENCE = "[^.!?]++[.!?]"


def families() -> list[str]:
    """A pattern for each family; its groups are question and answer.

    Each reads a text once: what can be repeated is possessive, and where an opening finds no end the pattern takes the
    rest of the text (then group 1 has no question mark, or both groups are empty), since no later opening finds one.
    """
    marked = rf"(?iuUs){ASKED}++(?:(.+?){TOLD}++(.+?)(?={ASKED}|$)|.*+)"
    answer = {1: rf"({_SENTENCE})", 2: rf"({_SENTENCE}(?:{_SENTENCE})?+)"}
    return [marked, *(rf"(?iuU)({opening} [^?]++(?:\?|\z)){answer[n]}?+" for opening, n in OPENINGS)]


#: Fixed value: a sentence that defines its subject.
DEFINITION = r"(?U)^((?:The\s+)?[A-Z][A-Za-z0-9\s]+?) (?:is|are) (?:a |an |the )?(.+)"
PAIR = "array<struct<question:string,answer:string>>"


#: Capitalised words that are no terms.
NO_TERMS = ("Navigation", "Index", "Next", "Previous", "Home", "Menu", "Search", "Click", "See", "Also")


def key_terms(text: Column, most: int = 20) -> Column:
    """Capitalised and technical terms of a text, each once, in order: the capitalised ones first."""
    caps = F.filter(t.capitalised(text), lambda x: (F.length(x) > 3) & ~x.isin(*NO_TERMS))
    return F.slice(F.array_distinct(F.concat(caps, t.technical(text))), 1, most)


def counters(contents: DataFrame, made: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the sources, and what ``process`` has made of them by kind."""
    counts = [x.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, x in {"sources": contents, **made}.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def is_valid_qa(question: Column, answer: Column) -> Column:
    noise = "(?U)" + "|".join(NOISE)
    low_q, low_a = t.strip(F.lower(question)), t.strip(F.lower(answer))
    sound = ~low_q.rlike(noise) & ~low_a.rlike(noise) & t.strip(question).endswith("?") & ~question.rlike(r"[\n|]")
    return sound & (F.length(question) > 15) & (F.length(answer) > 10) & (F.length(answer) < 250)


def qa_patterns(text: Column, most: int = 20) -> Column:
    """Pairs that match the question families, family by family; the first ``most`` valid ones."""
    none = F.array().cast(PAIR)

    def pairs(x: Column, k: int, pattern: str) -> Column:
        q, a = (F.regexp_extract_all(x, F.lit(pattern), F.lit(g)) for g in (1, 2))
        cut = (lambda x, n: F.substring(t.strip(x), 1, n)) if k == 0 else (lambda x, n: t.strip(x))
        return F.zip_with(q, a, lambda x, y: F.struct(cut(x, 200).alias("question"), cut(y, 500).alias("answer")))

    def of(x: Column) -> Column:
        marked, *open_ = (pairs(x, k, p) for k, p in enumerate(families()))
        # Cheap tests first: most texts ask nothing.
        return F.concat(F.when(x.rlike(r"[qQ][:\su]"), marked).otherwise(none), F.when(F.contains(x, F.lit("?")), F.concat(*open_)).otherwise(none))

    return F.slice(F.filter(t.bound(text, of), lambda p: is_valid_qa(p["question"], p["answer"])), 1, most)


def definitions(text: Column) -> Column:
    """Questions about the subjects of sentences like "X is a Y" among the first 30 sentences."""
    # Each step is bound to a lambda's variable, so that no pattern is matched twice.
    parts = F.transform(F.filter(F.slice(t.sentences(text), 1, 30), lambda s: s.rlike(DEFINITION)), lambda s: F.struct(t.strip(F.regexp_extract(s, DEFINITION, 1)).alias("subject"), t.strip(F.regexp_extract(s, DEFINITION, 2)).alias("what")))
    told = F.filter(parts, lambda p: F.length(p["subject"]).between(4, 50) & (F.length(p["what"]) >= 20) & ~F.lower(p["subject"]).isin(*GENERIC_SUBJECTS))
    pairs = F.transform(told, lambda p: F.struct(F.concat(F.lit("What is "), p["subject"], F.lit("?")).alias("question"), t.shorten(p["what"], 150).alias("answer")))
    return F.filter(pairs, lambda p: is_valid_qa(p["question"], p["answer"]))


def qa_pairs(contents: DataFrame, domain: str, text: str = "text", most: int = 25) -> DataFrame:
    """One row for each pair: columns of the content but its text, position, question, answer, domain, difficulty, tags.
    Pairs from patterns first, shortened to two sentences; each question once."""
    mark = lambda difficulty, tags: lambda p: F.struct(p["question"].alias("question"), p["answer"].alias("answer"), F.lit(difficulty).alias("difficulty"), F.array(*map(F.lit, tags)).alias("tags"))
    two = lambda a: t.shorten(t.strip(F.array_join(F.slice(F.split(a, r"(?U)(?<=[.!?])\s+"), 1, 2), " ")), 200)
    asked = F.transform(qa_patterns(t.clean(F.col(text))), lambda p: F.struct(p["question"].alias("question"), two(p["answer"]).alias("answer")))
    both = F.concat(F.transform(asked, mark("medium", [domain.lower()])), F.transform(definitions(F.col(text)), mark("easy", [domain.lower(), "definition"])))
    once = t.distinct_by(both, lambda p: t.strip(F.lower(p["question"])))
    rest = [c for c in contents.columns if c != text]
    return contents.select(*rest, F.posexplode(F.slice(once, 1, most)).alias("position", "p")).select(*rest, "position", "p.question", "p.answer", F.lit(domain).alias("domain"), "p.difficulty", "p.tags")


def cloze_tests(contents: DataFrame, domain: str, text: str = "text", seed: int = 0, most: int = 15) -> DataFrame:
    """Fill-in-the-blank tests of the first 30 sentences.  Of a sentence's candidate words the one with the smallest
    MD5 of seed, sentence and place is blanked, so that the choice is the same everywhere."""
    def candidates(s: Column) -> Column:
        bare = F.transform(F.split(s, r"(?U)\s+"), lambda word, i: F.struct(i.alias("i"), F.regexp_replace(word, r"[^\p{L}\p{N}_]", "").alias("answer")))
        sound = F.filter(bare, lambda w: (F.length(w["answer"]) >= 4) & ~F.lower(w["answer"]).isin(*CLOZE_STOP))
        kind = lambda w: F.when(w["answer"].rlike(r"\p{Lu}|_"), "term").when(w["answer"].rlike(r"^\p{Nd}+$"), "number").when(F.length(w["answer"]) >= 6, "word")
        keyed = F.transform(sound, lambda w: F.struct(F.md5(F.concat(F.lit(f"{seed}|"), s, F.lit("|"), w["i"].cast("string"))).alias("key"), w["i"].alias("i"), w["answer"].alias("answer"), kind(w).alias("kind")))
        return F.filter(keyed, lambda w: w["kind"].isNotNull())

    fits = lambda s: F.length(s).between(40, 300) & (F.size(F.split(s, r"(?U)\s+")) >= 6)
    chosen = F.transform(F.filter(F.slice(t.sentences(F.col(text)), 1, 30), fits), lambda s: F.struct(s.alias("s"), F.array_min(candidates(s)).alias("best")))
    tests = F.slice(F.filter(chosen, lambda x: x["best"].isNotNull()), 1, most)
    rest = [c for c in contents.columns if c != text]
    rows = contents.select(*rest, F.posexplode(tests).alias("position", "p"))
    masked = F.concat_ws(" ", F.transform(F.split("p.s", r"(?U)\s+"), lambda w, i: F.when(i == F.col("p.best.i"), "____").otherwise(w)))
    level = F.when(F.col("p.best.kind") == "number", "easy").when(F.col("p.best.kind") == "term", "medium").otherwise("hard")
    tags = F.array(F.lit(domain.lower()), F.lit("cloze"), F.col("p.best.kind"))
    return rows.select(*rest, "position", masked.alias("masked_text"), F.col("p.best.answer").alias("answer"), F.col("p.s").alias("original_text"), F.col("p.best.i").alias("mask_position"), F.lit(domain).alias("domain"), level.alias("difficulty"), tags.alias("tags"))


def first_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each normalised key; a minimum that is combined before the shuffle, so that a key which many
    rows share is no burden."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(t.strip(F.lower(F.col(key))).alias("k")).agg(first.alias("r")).select("r.*")


def shares(target: int, kinds: str = "all") -> tuple[int, int]:
    """60 % questions and 40 % cloze tests, rounded down; one kind alone gets the whole target."""
    return {"all": (int(target * 0.6), int(target * 0.4)), "benchmark": (target, 0), "masked": (0, target)}[kinds]


def quota(qa: DataFrame, cloze: DataFrame, target: int, kinds: str = "all", order: list[str] = ("url", "position")) -> tuple[DataFrame, DataFrame]:
    """The first pairs and tests, in their shares."""
    share = shares(target, kinds)
    return qa.orderBy(*order).limit(share[0]), cloze.orderBy(*order).limit(share[1])


def _check(kind: str, value: Column | None, chars: int | None) -> Column:
    text = F.lit(None).cast("string") if value is None else value
    return F.struct(F.lit(kind).alias("type"), text.alias("value"), F.lit(chars).cast("int").alias("chars"), F.lit(value is None).alias("case_sensitive"))


def answer_check(answer: Column) -> Column:
    """A short answer must hold the beginning of its first sentence, a long one a minimum length."""
    start = F.substring(F.substring_index(answer, ".", 1), 1, 50)
    return F.when(F.length(answer) < 100, _check("contains", start, None)).otherwise(_check("min_length", None, 50))


def word_check(answer: Column) -> Column:
    return _check("contains", answer, None)


def blank_prompt(masked: Column) -> Column:
    return F.concat(F.lit("Fill in the blank with the correct word or phrase:\n\n"), masked)


def qa_cases(qa: DataFrame, domain: str, order: list[str]) -> DataFrame:
    """Suite rows of questions and answers."""
    check = answer_check(F.col("answer"))
    return t.numbered(qa, order, "n").select(F.concat(F.lit(f"{slug(domain)}-qa-"), F.col("n").cast("string")).alias("id"), F.col("question").alias("prompt"), F.col("answer").alias("expected"), F.array(check).alias("assertions"), "tags")


def answer_cases(qa: DataFrame, domain: str, order: list[str]) -> DataFrame:
    """Suite rows that ask for the whole answer."""
    check = _check("contains", t.strip(F.col("answer")), None)
    tags = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit(domain.lower())))
    return t.numbered(qa, order, "n").select(F.concat(F.lit(f"{slug(domain)}-"), F.col("n").cast("string")).alias("id"), F.col("question").alias("prompt"), F.lit(None).cast("string").alias("expected"), F.array(check).alias("assertions"), tags.alias("tags"))


def cloze_cases(cloze: DataFrame, domain: str, order: list[str]) -> DataFrame:
    prompt, check = blank_prompt(F.col("masked_text")), word_check(F.col("answer"))
    return t.numbered(cloze, order, "n").select(F.concat(F.lit(f"{slug(domain)}-cloze-"), F.col("n").cast("string")).alias("id"), prompt.alias("prompt"), F.col("answer").alias("expected"), F.array(check).alias("assertions"), "tags")


def slug(domain: str) -> str:
    return domain.lower().replace(" ", "-")


def process(contents: DataFrame, domain: str, output: str = "all", order: list[str] = ("url",)) -> dict[str, DataFrame]:
    """What can be made of contents (text and the columns of ``order``), by kind of output: ``benchmark`` and ``masked``
    pairs and tests, ``roleplay`` cases and ``finetune`` messages; the kinds that are not asked for are missing.  For
    ``all``, pairs and tests are worked out once and stored, as messages are made of them as well."""
    made: dict[str, DataFrame] = {}
    once = keep if output == "all" else lambda rows: rows
    qa = once(qa_pairs(contents, domain)) if output in ("benchmark", "finetune", "all") else None
    cloze = once(cloze_tests(contents, domain)) if output in ("masked", "all") else None
    if qa is not None:
        made["benchmark"] = qa
    if cloze is not None:
        made["masked"] = cloze
    if output in ("roleplay", "all"):
        made["roleplay"] = persona_cases(contents.sparkSession, domain)
    if output in ("finetune", "all"):
        made["finetune"] = finetune(qa, cloze)
    return made


def generated_suite(contents: DataFrame, domain: str, target: int = 50, kinds: str = "all", order: list[str] = ("url",), seed: int = 0) -> DataFrame:
    """A suite of at most ``target`` cases: pairs and tests that differ, the first by ``order``, in the shares of
    ``quota``, then in an order that follows from a hash of seed and id."""
    by = [*order, "position"]
    qa = first_by_key(qa_pairs(contents, domain), "question", by) if kinds != "masked" else None
    cloze = first_by_key(cloze_tests(contents, domain), "masked_text", by) if kinds != "benchmark" else None
    share_qa, share_cloze = shares(target, kinds)
    parts = []
    if qa is not None:
        parts.append(qa_cases(qa.orderBy(*by).limit(share_qa), domain, by))
    if cloze is not None:
        parts.append(cloze_cases(cloze.orderBy(*by).limit(share_cloze), domain, by))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return every.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("id"))))


def finetune(qa: DataFrame, cloze: DataFrame | None) -> DataFrame:
    """One JSON text of messages for each pair and, if there are any, each test."""
    def messages(user: Column, assistant: Column) -> Column:
        turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
        return F.to_json(F.struct(F.array(turn("user", user), turn("assistant", assistant)).alias("messages")))

    a = qa.select(messages(F.col("question"), F.col("answer")).alias("value"))
    return a if cloze is None else a.unionByName(cloze.select(messages(F.concat(F.lit("Fill in the blank: "), F.col("masked_text")), F.col("answer")).alias("value")))


def persona(domain: str) -> dict:
    """A constant role with its dialogues; ``persona_cases`` makes suite rows of it."""
    return {
        "name": f"{domain.title()} Expert",
        "description": f"An AI assistant specialized in {domain}",
        "system_prompt": f"You are a helpful {domain} expert. Answer questions accurately and concisely.",
        "dialogues": [f"Tell me about {domain}"],
        "traits": ["knowledgeable", "helpful", "precise"],
    }


def persona_cases(spark, domain: str) -> DataFrame:
    return personas(spark.range(1).select(F.lit(domain).alias("domain"))).drop("domain")


def personas(domains: DataFrame) -> DataFrame:
    """Suite rows of the persona of each domain (domain)."""
    mark = "\x00"
    p = persona(mark)
    said = lambda text: F.replace(F.lit(text), F.lit(mark), F.col("domain"))
    src = domains.select("domain", F.posexplode(F.array(*map(said, p["dialogues"]))).alias("i", "prompt"))
    low = F.lower("domain")
    name = F.concat(F.replace(low, F.lit(" "), F.lit("-")), F.lit("-roleplay-"), (F.col("i") + 1).cast("string"))
    return src.select("domain", name.alias("id"), said(p["system_prompt"]).alias("system_prompt"), "prompt", F.lit(None).cast("string").alias("expected"), F.array(_check("min_length", None, 50)).alias("assertions"), F.array(F.lit("roleplay"), low).alias("tags"))
