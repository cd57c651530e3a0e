"""Analysis of system prompts: role, domain, keywords, capabilities, constraints, searches and categories."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

#: Fixed values.
ROLE_PATTERNS = (
    r"you are (?:a |an )?(.+?)(?:\.|,|who|that|$)",
    r"act as (?:a |an )?(.+?)(?:\.|,|who|that|$)",
    r"behave as (?:a |an )?(.+?)(?:\.|,|who|that|$)",
    r"assume the role of (?:a |an )?(.+?)(?:\.|,|who|that|$)",
    r"your role is (?:to be )?(?:a |an )?(.+?)(?:\.|,|$)",
)
#: Fixed values; the order breaks ties.
DOMAIN_KEYWORDS = {
    "code_review": ["code review", "review code", "code quality", "pull request", "pr review", "code feedback"],
    "code": ["code", "programming", "developer", "software", "engineer", "debug", "script", "function", "class", "api", "coding", "programmer"],
    "medical": ["medical", "health", "doctor", "patient", "diagnosis", "symptom", "treatment", "clinical", "healthcare"],
    "legal": ["legal", "law", "attorney", "lawyer", "contract", "court", "compliance", "regulation", "litigation"],
    "finance": ["finance", "financial", "banking", "investment", "trading", "stock", "money", "accounting", "tax"],
    "education": ["education", "teacher", "student", "learning", "course", "curriculum", "academic", "tutor"],
    "support": ["customer support", "help desk", "ticket", "troubleshoot", "customer service"],
    "writing": ["writing", "writer", "content", "article", "blog", "copywriting", "editing", "creative"],
    "data": ["data", "analysis", "analytics", "statistics", "database", "sql", "visualization", "metrics"],
    "security": ["security", "cybersecurity", "hacking", "vulnerability", "encryption", "firewall", "threat"],
    "devops": ["devops", "deployment", "ci/cd", "docker", "kubernetes", "infrastructure", "cloud", "aws", "azure"],
}
#: Fixed values.
CAPABILITY_PATTERNS = (
    r"(?:can|able to|capable of) (.+?)(?:\.|,|and|$)",
    r"(?:will|should) (.+?)(?:\.|,|and|$)",
    r"(?:helps?|assists?) (?:users? )?(?:to |with )?(.+?)(?:\.|,|and|$)",
    r"(?:provides?|offers?) (.+?)(?:\.|,|and|$)",
)
CONSTRAINT_PATTERNS = (
    r"(?:don't|do not|never|avoid|must not) (.+?)(?:\.|,|$)",
    r"(?:only|exclusively|solely) (.+?)(?:\.|,|$)",
    r"(?:limited to|restricted to) (.+?)(?:\.|,|$)",
    r"(?:within|inside) (.+?)(?:\.|,|$)",
)
#: Fixed values.
KEYWORD_STOP = ("your", "you", "the", "and", "for", "with", "that", "this", "are", "have", "will", "should", "must", "can", "may", "rules", "format", "response", "end", "start", "list")
#: Fixed values.
DOMAIN_TESTS = {
    "code": ["code_generation", "debugging", "explanation"],
    "medical": ["accuracy", "safety", "disclaimer"],
    "legal": ["accuracy", "disclaimer", "jurisdiction"],
    "finance": ["accuracy", "disclaimer", "risk"],
    "support": ["helpfulness", "clarity", "resolution"],
    "writing": ["creativity", "grammar", "style"],
}


#: Searches of a domain, of a role and of a keyword.
DOMAIN_QUERIES = ("{} best practices", "{} checklist", "{} common mistakes", "{} tips and tricks", "how to do {}", "{} guide", "{} examples")
ROLE_QUERIES = ("{} guide", "{} tips", "what does a {} do")
KEYWORD_QUERY = "{} best practices"


#: Pages to fall back to, by domain; the order decides between partial matches.
FALLBACK_URLS = {
    "code": ["https://google.github.io/styleguide/", "https://docs.python.org/3/tutorial/", "https://developer.mozilla.org/en-US/docs/Web/JavaScript/Guide", "https://wiki.c2.com/?CodeSmell"],
    "code_review": [
        "https://google.github.io/eng-practices/review/reviewer/",
        "https://smartbear.com/learn/code-review/best-practices-for-peer-code-review/",
        "https://wiki.c2.com/?CodeReviewPatterns",
        "https://docs.github.com/en/pull-requests/collaborating-with-pull-requests/reviewing-changes-in-pull-requests/about-pull-request-reviews",
    ],
    "programming": ["https://docs.python.org/3/faq/programming.html", "https://docs.python.org/3/tutorial/errors.html", "https://developer.mozilla.org/en-US/docs/Learn/JavaScript"],
    "python": ["https://docs.python.org/3/faq/programming.html", "https://docs.python.org/3/tutorial/", "https://wiki.python.org/moin/BeginnersGuide/NonProgrammers", "https://realpython.com/python-best-practices/"],
    "javascript": ["https://developer.mozilla.org/en-US/docs/Web/JavaScript/Guide", "https://developer.mozilla.org/en-US/docs/Learn/JavaScript/First_steps", "https://javascript.info/first-steps"],
    "support": ["https://www.zendesk.com/blog/customer-service-skills/", "https://help.zendesk.com/hc/en-us/articles/4408832479386-Best-practices-for-agents"],
    "writing": ["https://developers.google.com/style", "https://docs.microsoft.com/en-us/style-guide/welcome/"],
    "security": ["https://owasp.org/www-project-top-ten/", "https://cheatsheetseries.owasp.org/"],
    "medical": ["https://www.mayoclinic.org/diseases-conditions", "https://www.cdc.gov/health-topics.html"],
}
DEFAULT_URLS = ["https://docs.python.org/3/faq/programming.html", "https://developer.mozilla.org/en-US/docs/Learn", "https://wiki.c2.com/?DesignPatterns"]


def fallback_urls(domain_: Column) -> Column:
    """Of the domain itself, else of the first key that is part of it or has it as a part, else the default."""
    spoken = F.replace(F.lower(domain_), F.lit("_"), F.lit(" "))
    listed = lambda urls: F.array(*map(F.lit, urls))
    key = F.replace(spoken, F.lit(" "), F.lit("_"))
    rules = [(key == k, u) for k, u in FALLBACK_URLS.items()]
    rules += [(F.contains(spoken, F.lit(k)) | F.contains(F.lit(k), spoken), u) for k, u in FALLBACK_URLS.items()]
    out = F.when(rules[0][0], listed(rules[0][1]))
    for rule, u in rules[1:]:
        out = out.when(rule, listed(u))
    return out.otherwise(listed(DEFAULT_URLS))


def role(prompt: Column) -> Column:
    def cut(c: Column) -> Column:
        for word in ("who", "that"):
            c = F.regexp_replace(c, rf"(?iUd)\s+{word}\s.*$", "")
        return F.substring(c, 1, 100)

    out = None
    for p in ROLE_PATTERNS:
        found, value = prompt.rlike(f"(?iud){p}"), cut(t.strip(F.regexp_extract(prompt, f"(?iud){p}", 1)))
        out = F.when(found, value) if out is None else out.when(found, value)
    first = F.substring(F.substring_index(prompt, ".", 1), 1, 100)
    return out.otherwise(F.coalesce(t.blank_to_null(first), F.lit("AI Assistant")))


def domain(prompt: Column) -> Column:
    """The domain with the largest sum of words of the keywords found as substrings; ties go to the earlier one."""
    def best(low: Column) -> Column:
        rows = []
        for k, (name, words) in enumerate(DOMAIN_KEYWORDS.items()):
            score = sum((F.when(F.contains(low, F.lit(w)), len(w.split())).otherwise(0) for w in words), F.lit(0))
            rows.append(F.struct(score.alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("name")))
        return F.array_max(F.array(*rows))

    # Each step is bound, so that a prompt is lowered and its words are looked for once.
    return t.bound(t.bound(F.lower(prompt), best), lambda x: F.when(x["score"] > 0, x["name"]).otherwise("general"))


def keywords(prompt: Column, most: int = 20) -> Column:
    caps = F.filter(t.capitalised(prompt), lambda x: F.length(x) > 3)
    tech = t.technical(prompt)
    quoted = F.filter(F.regexp_extract_all(prompt, F.lit(r"[\"']([^\"']+)[\"']"), F.lit(1)), lambda x: (F.length(x) > 2) & (F.length(x) < 50))
    low = F.array_distinct(F.transform(F.concat(caps, tech, quoted), lambda x: F.lower(x)))
    return F.slice(F.filter(low, lambda x: (F.length(x) > 2) & ~x.isin(*KEYWORD_STOP)), 1, most)


#: Letters that equal an ASCII one if case is ignored.
_FOLDS = {"i": "iIİı", "k": "kK\u212a", "s": "sSſ"}


def _anywhere(pattern: str) -> str:
    """The pattern in any case.  Where none of its first letters stands its words are not tried, which takes most places."""
    first = sorted({word[0] for word in re.match(r"\(\?:([^()]*)\)", pattern)[1].split("|")})
    return f"(?=[{''.join(_FOLDS.get(x, x + x.upper()) for x in first)}])(?iud){pattern}"


def phrases(prompt: Column, patterns: tuple[str, ...], most: int = 10) -> Column:
    """What the patterns capture, pattern by pattern, if longer than five characters; not made distinct.

    A capture ends in its line, or at the end of the text.  What follows the last word or mark that can end one is cut
    off all other lines first: nothing there can match, and each attempt would read on to the line's end."""
    ends = r"(?iud)^(.*(?:\.|,|and))" if any("and|$" in p for p in patterns) else r"(?iud)^(.*[.,])"
    last = lambda lines: F.size(lines) - F.when(F.get(lines, F.size(lines) - 1) == "", 2).otherwise(1)
    short = lambda lines: F.array_join(F.transform(lines, lambda x, i: F.when(i >= last(lines), x).otherwise(F.regexp_extract(x, ends, 1))), "\n")
    found = t.bound(t.bound(F.split(prompt, "\n"), short), lambda x: F.concat(*[F.regexp_extract_all(x, F.lit(_anywhere(p)), F.lit(1)) for p in patterns]))
    return F.slice(F.transform(F.filter(F.transform(found, t.strip), lambda x: F.length(x) > 5), lambda x: F.substring(x, 1, 100)), 1, most)


def search_queries(domain_: Column, role_: Column, keywords_: Column, most: int = 12) -> Column:
    d = F.replace(domain_, F.lit("_"), F.lit(" "))
    r = F.substring(F.replace(F.replace(role_, F.lit("a "), F.lit("")), F.lit("an "), F.lit("")), 1, 50)
    text = lambda form, x: F.concat(F.lit(form.partition("{}")[0]), x, F.lit(form.partition("{}")[2]))
    of_domain = F.array(*[text(q, d) for q in DOMAIN_QUERIES])
    named = (role_ != "") & (role_ != "AI Assistant")
    of_role = F.when(named, F.array(*[text(q, r) for q in ROLE_QUERIES])).otherwise(F.array().cast("array<string>"))
    of_words = F.transform(F.slice(F.filter(keywords_, lambda x: F.length(x) > 4), 1, 3), lambda x: text(KEYWORD_QUERY, x))
    return F.slice(t.distinct_by(F.concat(of_domain, of_role, of_words), lambda x: F.lower(x)), 1, most)


def categories(domain_: Column, capabilities: Column, constraints: Column) -> Column:
    none = F.array().cast("array<string>")
    extra = None
    for name, tests in DOMAIN_TESTS.items():
        items = F.array(*map(F.lit, tests))
        extra = F.when(domain_ == name, items) if extra is None else extra.when(domain_ == name, items)
    parts = [F.array(F.lit("knowledge")), F.when(F.size(capabilities) > 0, F.array(F.lit("capability"))).otherwise(none), F.when(F.size(constraints) > 0, F.array(F.lit("constraint"))).otherwise(none)]
    return F.array_sort(F.array_distinct(F.concat(*parts, extra.otherwise(none))))


def analyse(prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
    p = F.col(prompt)
    out = prompts.withColumns({"domain": domain(p), "role": role(p), "keywords": keywords(p), "capabilities": phrases(p, CAPABILITY_PATTERNS), "constraints": phrases(p, CONSTRAINT_PATTERNS)})
    return out.withColumns({"queries": search_queries(F.col("domain"), F.col("role"), F.col("keywords")), "categories": categories(F.col("domain"), F.col("capabilities"), F.col("constraints"))})
