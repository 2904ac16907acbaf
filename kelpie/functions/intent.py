"""Understanding of questions: which kind of source they need, and the values they name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpie.functions.text import strip, text_or_empty

# ---- Fixed values: signal words (English and French); results depend on them ----------------------------------

LIVE = (
    "issue|issues|bug|bugs|ticket|tickets|task|tasks|merge.?requests?|pull.?requests?|mr|pr|pipeline|pipelines|ci|cd|build|builds|deploy|commit|commits|changelog|sprint|board|backlog|"
    "milestone|milestones|open|closed|in.?progress|wip|gitlab|jira|confluence|branch|repo|repository|real.?time|live|current|latest|recent|who.?assigned|assignee|reporter|status|priority|label|"
    r"diff|diffs|!\d{1,6}\b|#\d{1,6}\b|fichier|fichiers|branche|branches|depot|dep[oô]t|probl[eè]me|probleme|t[aâ]che|tache|bogue|montre.?moi|affiche.?moi|affiche|montre|liste.?moi|voir|statut|"
    r"[eé]tat|priorit[eé]|assign[eé]|ouvert|ferm[eé]|en.?cours|\b[A-Z]{2,9}-\d+\b"
)
KNOWLEDGE = (
    "how.?to|how.?do.?i|explain|what.?is|what.?are|analyze|analyse|guide|guides|documentation|docs|tutorial|architecture|design|pattern|best.?practices?|authenticate|authentication|oauth|jwt|"
    "implement|setup|configure|configuration|api.?reference|schema|traceback|solution|meaning|definition|describe|summarize|historical|according.?to|based.?on|from.?docs|explique|expliques|"
    "expliquer|comment.?ca.?marche|comment.?fonctionne|comment.?faire|qu.?est.?ce.?que|c.?est.?quoi|tutoriel|configurer|impl[eé]menter|d[eé]finition|signification|r[eé]soudre|meilleures?.?pratiques?"
)
BOTH = (
    "all.{0,20}(?:issue|bug|ticket|mr|commit)|(?:issue|bug|ticket|mr|commit).{0,20}all|summary|overview|report|dashboard|related.?to|context.?for|background.?on|tell.?me.?everything|"
    "give.?me.?all|what.?do.?we.?know|what.?happened"
)
FILE_NAME = r"\b[\w_\-]+\.(?:py|js|ts|go|java|rb|rs|cpp|c|cs|sh|yaml|yml|toml|json|md)\b"
KEY = r"\b[A-Z]{2,9}-\d+\b"
#: Words of a merge or issue state, as parts of words.
CLOSED = ["closed", "merged", "done", "resolved", "fixed", "completed"]
EVERY = ["all", "every", "both"]
#: Phrase -> status; phrases of STATUS_PHRASES count as parts of the text and come first, then words, in this order.
STATUSES = {
    "closed": "Done", "close": "Done", "done": "Done", "resolved": "Done", "fixed": "Done", "completed": "Done", "finished": "Done", "finish": "Done",
    "open": "Open", "opened": "Open", "new": "Open", "created": "Open",
    "in progress": "In Progress", "in-progress": "In Progress", "ongoing": "In Progress", "wip": "In Progress", "started": "In Progress",
    "in review": "In Review", "review": "In Review", "reviewing": "In Review", "testing": "Testing", "qa": "Testing", "blocked": "Blocked", "block": "Blocked",
    "todo": "To Do", "to do": "To Do", "backlog": "Backlog", "pending": "To Do", "archived": "Closed",
    "à faire": "To Do", "a faire": "To Do", "non résolu": "To Do", "non resolu": "To Do", "en cours": "In Progress", "en-cours": "In Progress", "en cours de": "In Progress",
    "terminé": "Done", "termine": "Done", "terminée": "Done", "terminee": "Done", "résolu": "Done", "resolu": "Done", "fermé": "Done", "ferme": "Done",
    "bloqué": "Blocked", "bloque": "Blocked", "en attente": "To Do", "en révision": "In Review", "en revision": "In Review", "en test": "Testing", "en recette": "Testing",
}
STATUS_PHRASES = [
    "in progress", "in-progress", "in review", "to do", "en cours de", "en cours", "en-cours", "à faire", "a faire", "non résolu", "non resolu", "en attente", "en révision", "en revision", "en test", "en recette",
]
#: Status -> category, the same in every language of the tracker.
STATUS_CATEGORIES = {
    "Done": "Done", "Open": "To Do", "To Do": "To Do", "Backlog": "To Do", "In Progress": "In Progress", "In Review": "In Progress", "Testing": "In Progress", "Blocked": "In Progress", "Closed": "Done",
}
PRIORITIES = {
    "urgent": "Highest", "critical": "Highest", "blocker": "Highest", "blocking": "Highest", "highest": "Highest", "high priority": "High", "high": "High", "medium": "Medium", "normal": "Medium",
    "low priority": "Low", "low": "Low", "minor": "Low", "lowest": "Lowest", "trivial": "Lowest",
}
PRIORITY_PHRASES = ["high priority", "low priority"]
REPORTER_WORDS = (
    r"author(?:ed)?|reporter?|reported\s+by|created\s+by|opened\s+by|filed\s+by|submitted\s+by|raised\s+by|logged\s+by|is\s+the\s+author|auteur|rapporteur|signal[eé]\s+par|cr[eé][eé]\s+par"
)
REPORTER_NAMES = [
    r"\b(?:reported|author(?:ed)?|filed|created|opened|raised|submitted|logged)\s+by\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})",
    r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\s+is\s+the\s+(?:author|reporter)",
    r"\bwhere\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\s+is\b",
]
MONTHS = {
    "january": "01", "february": "02", "march": "03", "april": "04", "may": "05", "june": "06", "july": "07", "august": "08", "september": "09", "october": "10", "november": "11", "december": "12",
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "jun": "06", "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12",
}
AFTER = r"after|since|from|starting|created\s+after|added\s+after"
BEFORE = r"before|until|up\s+to|prior\s+to|created\s+before"
NEWEST = r"most\s+recent|latest|newest|recently\s+created|last\s+created|most\s+recently\s+created"
#: Words dropped from page searches: commands first; where too little is left, fillers.
COMMANDS = (
    "confluence|search|find|show|list|get|me|our|the|a|an|page|pages|doc|docs|documentation|wiki|knowledge|base|in|on|about|for|what|is|are|how|do|we|have|please|can|you|tell|give|recent|latest|"
    "updated|new|modified|content|space|spaces"
)
FILLERS = (
    "find|show|get|list|give|tell|me|us|the|a|an|in|of|for|about|related|to|confluence|page|pages|document|documents|documentation|wiki|space|summary|summarize|summarise|explain|describe|what|is|"
    "are|any|some|all|and|with|that|from|its|their"
)
COUNTING = (
    r"how many|how much|count|counting|total|totals|total number|number of|tally|give me (?:a |the )?count|what.?s the (?:total|count|number)|tell me how many|show me how many|quantit(?:y|ies)"
)
DETAILS = (
    r"explain|describe|detail|details|what are they|show (?:me )?(?:them|each|all)|list (?:them|each|all)|and who|by whom|who made|who created|who assigned|what (?:is|are|were|was) (?:each|they|it)|"
    r"impact|affect|cause|why|reason|are any|is any|which (?:one|ones|are)|tell me (?:about|more)|give me (?:more|details)|summarize|summary"
)

# ---------------------------------------------------------------------------------------------------------------


def _count(c: Column, words: str) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(rf"(?iU)\b(?:{words})\b"))


def has_key(c: Column) -> Column:
    return text_or_empty(c).rlike(KEY)


def route_of(c: Column) -> Column:
    """'rag', 'sentries' or 'both': signal counts with two more for a ticket key and for a file name; a key with
    a knowledge signal needs both; else a side wins alone or by more than one; else both."""
    key, named = has_key(c), text_or_empty(c).rlike(rf"(?i){FILE_NAME}")
    live = _count(c, LIVE) + F.when(key, 2).otherwise(0) + F.when(named, 2).otherwise(0)
    docs = _count(c, KNOWLEDGE)
    return (
        F.when(key & (docs > 0), "both").when((live > 0) & (docs == 0), "sentries").when((docs > 0) & (live == 0), "rag")
        .when((live > 0) & (_count(c, BOTH) > 0), "both").when((docs > 0) & (live > docs + 1), "sentries").when((live > 0) & (docs > live + 1), "rag").otherwise("both"))


def says(c: Column, words: str) -> Column:
    """Whether the text has one of the alternatives as words, in any letter case."""
    return text_or_empty(c).rlike(rf"(?iU)\b(?:{words})\b")


def canonical(c: Column, table: dict[str, str], phrases: list[str] | tuple = ()) -> Column:
    """The value of the first of the phrases that the text contains, else of the first entry of the table that it
    has as words; null if none."""
    low, out = F.lower(text_or_empty(c)), F.lit(None).cast("string")
    for word in reversed(table):
        out = F.when(low.rlike(rf"(?U)\b{word}\b"), table[word]).otherwise(out)
    for phrase in reversed(phrases):
        out = F.when(F.contains(low, F.lit(phrase)), table[phrase]).otherwise(out)
    return out


def status_of(c: Column) -> Column:
    return canonical(c, STATUSES, STATUS_PHRASES)


def priority_of(c: Column) -> Column:
    return canonical(c, PRIORITIES, PRIORITY_PHRASES)


def category_of(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_CATEGORIES.items() for x in kv]), status)


def state_of(c: Column) -> Column:
    """closed, all or opened, by parts of words."""
    low = F.lower(text_or_empty(c))
    holds = lambda parts: low.rlike("|".join(parts))
    return F.when(holds(CLOSED), "closed").when(holds(EVERY), "all").otherwise("opened")


def reporter_name(c: Column) -> Column:
    """The person in 'reported by X', 'X Y is the author' or 'where X Y is'; null if none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text_or_empty(c), t, 1), F.lit("")) for t in REPORTER_NAMES])


def iso_date(c: Column) -> Column:
    """The first ISO date in the text, else the first 'Month D, YYYY' in prose; null if none."""
    text = text_or_empty(c)
    iso = F.nullif(F.regexp_extract(text, r"(?U)\b(\d{4}-\d{2}-\d{2})\b", 1), F.lit(""))
    part = lambda g: F.regexp_extract(text, rf"(?iU)\b({'|'.join(MONTHS)})\s+(\d{{1,2}}),?\s+(\d{{4}})\b", g)
    number = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    prose = F.when(part(0) != "", F.concat_ws("-", part(3), F.element_at(number, F.lower(part(1))), F.lpad(part(2), 2, "0")))
    return F.coalesce(iso, prose)


def date_bounds(c: Column) -> Column:
    """struct(after, before): the date of the text as the one or the other, by its first fitting kind of word."""
    day, nothing = iso_date(c), F.lit(None).cast("string")
    later, sooner = says(c, AFTER), says(c, BEFORE)
    return F.struct(F.when(later, day).alias("after"), F.when(~later & sooner, day).otherwise(nothing).alias("before"))


def search_terms(c: Column, most: int = 60) -> Column:
    """What a page search asks for: the lower-cased text without commands; where that has under three characters,
    the text without fillers, cut; where that has too, the text."""
    text = text_or_empty(c)
    without = lambda x, words: strip(F.regexp_replace(F.regexp_replace(x, rf"(?iU)\b(?:{words})\b", " "), r"\s+", " "))
    first, second = without(F.lower(text), COMMANDS), without(text, FILLERS)
    second = F.left(F.when(second != "", second).otherwise(text), F.lit(most))
    return F.when(F.length(first) >= 3, first).when(F.length(second) >= 3, second).otherwise(text)


def only_counts(c: Column) -> Column:
    """Asks for a number, without details, reasons or a list."""
    return says(c, COUNTING) & ~says(c, DETAILS)


def without_keys(c: Column) -> Column:
    """The question without ticket keys; unchanged if nothing else is left."""
    rest = strip(F.regexp_replace(F.regexp_replace(text_or_empty(c), KEY, ""), r"\s{2,}", " "))
    return F.when(F.length(rest) > 0, rest).otherwise(c)


def flag(c: Column, name: str) -> Column:
    """The value of an inline flag such as --hops 2; null if absent."""
    return F.nullif(F.regexp_extract(text_or_empty(c), rf"--{name}[ =](\S+)", 1), F.lit(""))
