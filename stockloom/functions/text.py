"""Product text and tokens."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A token is a run of at least two letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"
# What lies between such runs and single letters. Splitting there takes half the time of looking for tokens.
NO_TOKEN = r"[^\p{L}\p{N}_]+"

# Common English words that carry no meaning of their own.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being "
    "below between both but by can could did do does doing don down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it "
    "its itself just me more most my myself no nor not now of off on once only or other our ours "
    "ourselves out over own same she should so some such than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with would you your yours yourself yourselves"
).split()


def product_text(name: Column, category: Column, description: Column) -> Column:
    """Name, category and description in one text; a missing one leaves nothing."""
    empty = F.lit("")
    return F.trim(F.concat_ws(" ", F.coalesce(name, empty), F.coalesce(category, empty), F.coalesce(description, empty)))


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case tokens of a whole text, repeats kept, stop words left out."""
    words = STOP_WORDS if stop_words is None else stop_words
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(words)) if words else found
