"""Type expressions in one spelling, by a fold over their tokens with a stack of open brackets.

Optional[X], Union[...] and A | B become one sorted set of alternatives at every depth, and the `typing` aliases of built-in
generics become these. Anything else keeps its structure: brackets without a name before them, calls, braces and quoted
strings are taken as they stand, and so is text whose brackets do not match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modules whose prefix says nothing, and aliases of built-in generics.
MODULES = ("typing", "typing_extensions", "t", "collections", "collections.abc")
ALIASES = {
    "Dict": "dict",
    "List": "list",
    "Set": "set",
    "FrozenSet": "frozenset",
    "Tuple": "tuple",
    "Type": "type",
    "Deque": "deque",
    "DefaultDict": "defaultdict",
    "OrderedDict": "OrderedDict",
    "Counter": "Counter",
    "ChainMap": "ChainMap",
}

# An expression is its alternatives and whether it is a union; a frame is one open bracket: the name before it, finished
# arguments, alternatives of the argument at hand, and the text at hand, which may end in a finished generic.
_EXPR = "struct<union:boolean,of:array<string>>"
_FRAME = f"struct<head:string,args:array<{_EXPR}>,of:array<string>,several:boolean,text:string,done:{_EXPR},tail:string,raw:string>"
_TOKENS = r"""('[^']*'|"[^"]*"|[\[\](){},|]|[^\[\](){},|'"]+|['"])"""


def _bare(name: Column) -> Column:
    return F.regexp_replace(name, rf"^(?:{'|'.join(m.replace('.', '[.]') for m in sorted(MODULES, key=len, reverse=True))})\.([^.]*)$", "$1")


def _alias(name: Column) -> Column:
    """The built-in generic of a name, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair)), _bare(name))


def _expr(union, of: Column) -> Column:
    return F.struct((union if isinstance(union, Column) else F.lit(union)).alias("union"), of.alias("of")).cast(_EXPR)


def _union(of: Column) -> Column:
    return _expr(True, F.array_sort(F.array_distinct(of)))


def _show(e: Column) -> Column:
    return F.when(e["union"], F.concat(F.lit("Union["), F.array_join(e["of"], ", "), F.lit("]"))).otherwise(e["of"][0])


def _frame(f: Column | None = None, **fields) -> Column:
    names = ("head", "args", "of", "several", "text", "done", "tail", "raw")
    empty = {"args": F.array(), "of": F.array(), "several": F.lit(False), "done": F.lit(None), **dict.fromkeys(("head", "text", "tail", "raw"), F.lit(""))}
    return F.struct(*((fields[n] if n in fields else empty[n] if f is None else f[n]).alias(n) for n in names)).cast(_FRAME)


def _piece(f: Column) -> Column:
    """The expression at hand."""
    name = F.trim(f["text"])
    return F.when(f["done"].isNotNull() & (F.trim(f["tail"]) == ""), f["done"]).otherwise(_expr(False, F.array(F.coalesce(_alias(name), name))))


def _argument(f: Column) -> Column:
    return F.when(f["several"], _union(F.concat(f["of"], _piece(f)["of"]))).otherwise(_piece(f))


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _generic(head: Column, args: Column) -> Column:
    of = F.flatten(F.transform(args, lambda a: a["of"]))
    name = F.trim(head)
    whole = F.concat(F.coalesce(_alias(name), name), F.lit("["), F.array_join(F.transform(args, _show), ", "), F.lit("]"))
    return F.when((_bare(name) == "Optional") & (F.size(args) == 1), _union(F.concat(of, F.array(F.lit("None"))))).when(_bare(name) == "Union", _union(of)).otherwise(_expr(False, F.array(whole)))


def canonical_type(text: Column) -> Column:
    """A type expression in the one spelling that all spellings of the type share; null for null."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKENS), 1)
    state = lambda top, below, plain, bad: F.struct(top.alias("top"), below.alias("below"), plain.cast("int").alias("plain"), bad.alias("bad"))

    def say(f, t):
        """The frame with a token of text."""
        return _frame(f, text=F.concat(f["text"], t), tail=F.when(f["done"].isNull(), f["tail"]).otherwise(F.concat(f["tail"], t)), raw=F.concat(f["raw"], t))

    def step(s, t):
        top, below = s["top"], s["below"]
        opens, closes = t.isin("[", "(", "{"), t.isin("]", ")", "}")
        # a bracket of another kind, or one without a name before it, is text up to its end
        named = (t == "[") & (F.trim(top["text"]) != "") & top["done"].isNull()
        plain = F.when(closes, s["plain"] - 1).when(opens, s["plain"] + 1).otherwise(s["plain"])
        opened = state(_frame(head=top["text"]), F.concat(below, F.array(top)), F.lit(0), s["bad"])
        closed = _let(
            F.struct(F.element_at(F.when(F.size(below) > 0, below).otherwise(F.array(top)), -1).alias("under"), _generic(top["head"], F.concat(top["args"], F.array(_argument(top)))).alias("made"), F.concat(F.lit("["), top["raw"], F.lit("]")).alias("raw")),
            lambda x: _frame(x["under"], text=F.concat(x["under"]["text"], x["raw"]), done=x["made"], tail=F.lit(""), raw=F.concat(x["under"]["raw"], x["raw"])),
        )
        shut = state(closed, F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0))), F.lit(0), s["bad"] | (F.size(below) == 0))
        comma = state(_frame(top, args=F.concat(top["args"], F.array(_argument(top))), of=F.array().cast("array<string>"), several=F.lit(False), text=F.lit(""), done=F.lit(None).cast(_EXPR), tail=F.lit(""), raw=F.concat(top["raw"], t)), below, F.lit(0), s["bad"])
        bar = state(_frame(top, of=F.concat(top["of"], _piece(top)["of"]), several=F.lit(True), text=F.lit(""), done=F.lit(None).cast(_EXPR), tail=F.lit(""), raw=F.concat(top["raw"], t)), below, F.lit(0), s["bad"])
        word = state(say(top, t), below, plain, s["bad"] | (plain < 0))
        return F.when((s["plain"] > 0) | ~t.isin("[", "]", ",", "|"), word).when(t == "[", F.when(named, opened).otherwise(word)).when(t == "]", shut).when((t == ",") & (F.size(below) > 0), comma).when(t == "|", bar).otherwise(word)

    start = state(_frame(), F.array().cast(f"array<{_FRAME}>"), F.lit(0), F.lit(False))
    name = F.trim(text)
    finish = lambda s: F.when(s["bad"] | (F.size(s["below"]) > 0) | (s["plain"] != 0), F.coalesce(_alias(name), name)).otherwise(_show(_argument(s["top"])))
    plain_name = F.coalesce(_alias(name), name)
    return F.when(~text.rlike(r"[\[\]|]"), plain_name).when(text.isNotNull(), F.aggregate(tokens, start, step, finish))
