"""What a page is about and how much it matters, by rules on its path, its words and its place in the site."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import js, urls

# Categories in the order of their sections, rules in the order in which they are tried, weights.
CATEGORIES = ("Getting Started", "Documentation", "Guides", "API Reference", "Product", "Resources", "Support", "Company", "Blog")
OPTIONAL = "Optional"
PATHS = (
    ("getting-started|quickstart|quick-start|start|onboarding", "Getting Started"),
    ("docs?|documentation|manual", "Documentation"),
    ("guides?|tutorials?|how-to|walkthroughs?", "Guides"),
    ("api|reference|sdk", "API Reference"),
    ("product|features?|pricing|solutions?", "Product"),
    ("resources?|changelog|release-notes|downloads?|templates?", "Resources"),
    ("support|help|faq|contact", "Support"),
    ("about|company|team|careers|jobs|press|partners", "Company"),
    ("blog", "Blog"),
    ("news", "Blog"),
)
KEYWORDS = (
    ("quickstart|getting started|installation|set ?up your", "Getting Started"),
    ("api reference|endpoint|sdk reference|rest api|graphql", "API Reference"),
    ("guide|tutorial|walkthrough|how to|step[- ]by[- ]step", "Guides"),
    ("pricing|plans?|core features?", "Product"),
    ("frequently asked|faq|support|help center", "Support"),
    ("about us|our team|careers|we're hiring", "Company"),
    ("changelog|release notes|what's new", "Resources"),
)
WEIGHTS = {"Getting Started": 30, "Documentation": 28, "API Reference": 26, "Guides": 22, "Product": 18, "Resources": 12, "Support": 12, "Blog": 10, "Company": 8}
OTHER_WEIGHT = 5
HIGH, MEDIUM = 45, 20


def rule_category(url: Column, title: Column, headings: Column) -> Column:
    """The category of the first rule that holds; null where none does. Paths tell case apart, words do not."""
    p = urls.path(url)
    words = F.concat_ws(" ", js.text(title), F.array_join(F.slice(F.coalesce(headings, F.array().cast("array<string>")), 1, 5), " "))
    tests = [(p.rlike(f"^/(?:{rule})(?:/|\\z)"), c) for rule, c in PATHS] + [(words.rlike(js.any_word(rule)), c) for rule, c in KEYWORDS]
    return F.coalesce(*[F.when(test, F.lit(c)) for test, c in tests])


def category(url: Column, title: Column, headings: Column) -> Column:
    """struct of category and confident: without a rule a page is a Resource, not confidently."""
    found = rule_category(url, title, headings)
    return F.struct(F.coalesce(found, F.lit("Resources")).alias("category"), found.isNotNull().alias("confident"))


def rank(name: Column) -> Column:
    """Place of a category, from 1; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for i, c in enumerate(CATEGORIES) for x in (c, i + 1)]), name)


def importance(is_home: Column, cat: Column, depth: Column, words: Column, inbound: Column, has_markdown: Column) -> Column:
    """A whole number, 0 at least, as double."""
    table = F.create_map(*[F.lit(x) for c, w in WEIGHTS.items() for x in (c, float(w))])  # one reference to cat: it may be a long expression
    weight = F.coalesce(F.try_element_at(table, cat), F.lit(float(OTHER_WEIGHT)))
    length = F.when(words < 60, -25.0).when(words > 800, 15.0).when(words > 300, 10.0).otherwise(0.0)
    score = F.when(is_home, 40.0).otherwise(0.0) + weight - depth * 4.0 + F.least(inbound, F.lit(20)) * 1.5 + length + F.when(has_markdown, 3.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), js.rounded(score).cast("double"))


def band(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")
