"""JSON-LD as variant values: walks of any depth, question-answer pairs and authors, as expressions on one row.

Expressions are SQL text, which a session parses at once; built from columns they would take
it seconds. A walk is one fold. Its state is the list of nodes in document order; each step
puts the members of all lists and objects that were not yet looked into in their place, so
there are as many real steps as the document is deep, and a step after the last one does
nothing.

Of a key that an object has twice the last value counts, if the session allows such keys
(``spark.sql.variant.allowDuplicateKeys``); numbers that JSON does not know (NaN) make a
document unreadable, and an unreadable document holds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

# Schema.org types and properties that are read.
ARTICLES = ("Article", "NewsArticle", "BlogPosting", "Report", "TechArticle")
CONTAINERS = ("mainEntity", "@graph", "itemListElement", "hasPart")
QUESTION, ANSWER = ("name", "question"), ("acceptedAnswer", "suggestedAnswer")

_NAMES = count()
_NODES = "array<struct<v:variant,done:boolean>>"


def _fn(body: Callable[[str], str]) -> str:
    """A lambda of one variable with a name of its own."""
    x = f"x{next(_NAMES)}"
    return f"{x} -> {body(x)}"


def _let(value: str, body: Callable[[str], str]) -> str:
    return f"get(transform(array({value}), {_fn(body)}), 0)"


def members(value: str) -> str:
    """The members of a list, null for any other value."""
    return f"try_variant_get({value}, '$', 'array<variant>')"


def fields(value: str) -> str:
    """The fields of an object as a map, null for any other value."""
    return f"try_variant_get({value}, '$', 'map<string,variant>')"


def _node(value: str, done: bool) -> str:
    return f"named_struct('v', {value}, 'done', {str(done).lower()})"


def _pending(values: str) -> str:
    return f"transform({values}, {_fn(lambda y: _node(y, False))})"


def _walk(start: str, steps: str, kept: Callable[[str], str]) -> str:
    """Nodes below ``start`` in document order: lists are replaced by their members, other values by what ``kept`` makes of them."""
    inside = _fn(lambda p: f"CASE WHEN {p}.done THEN array({p}) ELSE coalesce({_pending(members(p + '.v'))}, {kept(p + '.v')}) END")
    state = lambda nodes: _let(nodes, lambda x: f"named_struct('nodes', {x}, 'open', exists({x}, {_fn(lambda p: f'NOT {p}.done')}))")
    step = f"(acc, k) -> CASE WHEN acc.open THEN {state(f'flatten(transform(acc.nodes, {inside}))')} ELSE acc END"
    return f"aggregate(sequence(1, {steps}), named_struct('nodes', array({_node(start, False)}), 'open', true), {step}, acc -> transform(acc.nodes, {_fn(lambda p: p + '.v')}))"


def things(document: str, text: str) -> str:
    """The objects of a document, a container before what it holds; ``text`` is the document as written, whose brackets bound the walk."""
    held = lambda m: _pending(f"filter(array({', '.join(f'''{m}['{k}']''' for k in CONTAINERS)}), {_fn(lambda y: f'{y} IS NOT NULL')})")
    kept = lambda v: _let(fields(v), lambda m: f"CASE WHEN {m} IS NULL THEN CAST(array() AS {_NODES}) ELSE concat(array({_node(v, True)}), {held(m)}) END")
    return _walk(document, rf"regexp_count({text}, r'[\[{{]') * 2 + 1", kept)


def leaves(value: str) -> str:
    """A value that is no list, or the members of lists in lists."""
    return _walk(value, rf"coalesce(regexp_count(CAST({value} AS STRING), r'\['), 0) + 1", lambda v: f"array({_node(v, True)})")


def text_of(value: str) -> str:
    """A scalar as text, truth values as True and False, lists and objects as JSON; null for null."""
    return f"CASE WHEN schema_of_variant({value}) = 'BOOLEAN' THEN initcap(CAST({value} AS STRING)) ELSE CAST({value} AS STRING) END"


def _filled(value: str) -> str:
    """Whether a value says something: not null, false, zero, or empty."""
    return _let(f"CAST({value} AS STRING)", lambda s: f"{s} <> '' AND (schema_of_variant({value}) = 'STRING' OR {s} NOT IN ('[]', '{{}}', 'false', '0', '0.0', '-0.0'))")


def first_filled(own: str, names: Sequence[str]) -> str:
    """The first of the named fields that says something, else null."""
    return f"coalesce({', '.join(_let(f'''{own}['{n}']''', lambda v: f'CASE WHEN {_filled(v)} THEN {v} END') for n in names)})"


def of_kind(found: str, kinds: Sequence[str]) -> str:
    """The objects among ``found`` whose ``@type``, one or several, is among ``kinds``, as maps of their fields."""
    listed = ", ".join(f"'{k}'" for k in kinds)
    named = lambda m: f"coalesce({members(m + '''['@type']''')}, array({m}['@type']))"
    is_one = _fn(lambda k: f"coalesce(schema_of_variant({k}) = 'STRING' AND CAST({k} AS STRING) IN ({listed}), false)")
    return f"filter(transform({found}, {_fn(fields)}), {_fn(lambda m: f'exists({named(m)}, {is_one})')})"


def texts(value: str, prop: str) -> str:
    """Texts of a value: itself, an object's property (empty if it says nothing), or those of a list's members."""
    one = _fn(lambda v: _let(fields(v), lambda m: f"CASE WHEN {m} IS NULL THEN {text_of(v)} ELSE coalesce({_let(first_filled(m, [prop]), text_of)}, '') END"))
    return f"filter(transform({leaves(value)}, {one}), {_fn(lambda x: f'{x} IS NOT NULL')})"


def asked(own: str) -> str:
    """What a question object asks and its first answer, as written."""
    answer = _let(first_filled(own, ANSWER), lambda a: f"CASE WHEN {members(a)} IS NULL THEN {a} ELSE try_variant_get({a}, '$[0]', 'variant') END")
    told = _let(answer, lambda a: f"get({texts(a, 'text')}, 0)")
    return f"named_struct('question', coalesce({_let(first_filled(own, QUESTION), text_of)}, ''), 'answer', coalesce({told}, ''))"


def author_of(own: str) -> str:
    """Author names of an article object."""
    return f"CASE WHEN {own}['author'] IS NULL THEN CAST(array() AS array<string>) ELSE {texts(own + '''['author']''', 'name')} END"


#: Of (v, d) pairs in the column ``read``, documents as variants and as written: their objects, one list a document.
THINGS = f"transform(read, d -> {things('d.v', 'd.d')})"
#: Of the column ``things``: question and answer as written; names of authors, one list a document.
PAIRS = f"transform({of_kind('flatten(things)', ['Question'])}, q -> {asked('q')})"
AUTHORS = f"transform(things, d -> flatten(transform({of_kind('d', ARTICLES)}, a -> {author_of('a')})))"
