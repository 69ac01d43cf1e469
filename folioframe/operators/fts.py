"""Full-text search: an inverted index of folded tokens and a query language of terms, phrases, prefixes, first
tokens, NEAR groups, column filters and AND / OR / NOT.

A query is evaluated in the index: one pass over the postings of its words, and one row for each document with any. An
index may hold several texts of a document, its columns: a posting's place tells the column and the token's number there.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lower-case Latin letters with marks and their plain forms, by canonical decomposition.
MARKED = "".join(c for c in map(chr, range(0xC0, 0x1F00)) if unicodedata.normalize("NFD", c)[0] in "abcdefghijklmnopqrstuvwxyz")
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)
#: Marks that are written after a letter by themselves, as a class of a regular expression.
MARKS = f"[{chr(0x300)}-{chr(0x36F)}]"
_FOLDED = str.maketrans(MARKED, PLAIN, "".join(map(chr, range(0x300, 0x370))))


def fold(text: Column) -> Column:
    """Lower case, Latin letters without diacritics; other scripts keep their marks."""
    return F.translate(F.regexp_replace(F.lower(text), MARKS, ""), MARKED, PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters, marks and digits of the folded text. Folding makes no letter or mark anything else, so the text is
    split first and only tokens with more than ASCII are folded."""
    folded = lambda t: F.when(F.octet_length(t) > F.char_length(t), F.translate(F.regexp_replace(t, MARKS, ""), MARKED, PLAIN)).otherwise(t)
    return F.filter(F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}\p{M}]+"), folded), lambda t: t != "")


def query_tokens(text: str) -> list[str]:
    """The tokens of a text as tokens() finds them."""
    plain = text.lower().translate(_FOLDED)
    return "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in plain).split()


#: Places of one column; a document has at most so many tokens in it.
COLUMN = 1 << 40


def postings(docs: DataFrame, key: str | list[str], texts: str | list[str]) -> DataFrame:
    """(token, *key, place): the inverted index, one row for each token. place is the token's number in its text, plus
    COLUMN times the number of the column in `texts`."""
    keys, texts = ([x] if isinstance(x, str) else x for x in (key, texts))
    placed = [F.transform(tokens(F.coalesce(F.col(t), F.lit(""))), lambda token, i: F.struct(token.alias("token"), (i + F.lit(n * COLUMN)).alias("place"))) for n, t in enumerate(texts)]  # noqa: B023
    return docs.select(*keys, F.explode(F.concat(*placed)).alias("_at")).select("_at.token", *keys, "_at.place")


def write_index(index: DataFrame, path: str, key: str) -> None:
    """Store an index in the order of its tokens, in ranges, so that a query's words lead to few row groups. A frequent
    word is many ranges, by its documents."""
    index.repartitionByRange(F.col("token"), F.col(key)).sortWithinPartitions("token", key, "place").write.mode("overwrite").option("parquet.block.size", str(8 << 20)).parquet(path)


class QueryError(ValueError):
    """The query is not well formed."""


_LEXEME = re.compile(r'\s*(?:(NEAR)\s*\(|(\^?)"([^"]*)"|(\()|(\))|(,)|(-?\s*(?:\{[^}]*\}|\w+))\s*:(?=\s*\S)|(\^?)([^\s()",:]+))')


def parse(query: str, columns: tuple[str, ...] = ()):
    """A tree of ("term", tokens, is_prefix, is_first) leaves and ("near", leaves, distance) under ("and" | "or" | "not",
    left, right) and ("only", numbers of columns, tree). Words side by side are AND; NOT binds tighter than AND, AND
    tighter than OR; ^ asks for the first token of a column. A name or {names} and a colon before a word, phrase or bracket limit
    it to these columns, with a minus before them to all others; a name that is not among `columns` is an error. None for
    a query without words."""
    found, at = [], 0
    while at < len(query.rstrip()):
        m = _LEXEME.match(query, at)
        if not m:
            raise QueryError(f"cannot read the query at {at}")
        near, first, phrase, opens, closes, comma, only, caret, word = m.groups()
        at = m.end()
        if near:
            leaf, at = _near(query, at)
            found.append(leaf)
        elif only:
            named, known = {x.lower() for x in re.findall(r"\w+", only)}, [c.lower() for c in columns]
            if unknown := named - set(known):
                raise QueryError(f"no column {min(unknown)}")
            found.append(("only", frozenset(i for i, c in enumerate(known) if (c in named) != only.startswith("-"))))
        elif phrase is not None or word and word not in ("AND", "OR", "NOT"):
            found.append(_leaf(phrase, word, first or caret, at < len(query) and query[at] == "*"))
            at += phrase is not None and found[-1][2]
        elif comma:
            raise QueryError("a comma stands in NEAR only")
        else:
            found.append(opens or closes or word)
    tree, rest = _either(found)
    if rest:
        raise QueryError(f"unexpected {rest[0]}")
    return tree


def _leaf(phrase, word, caret, star):
    body = phrase if phrase is not None else word
    return "term", query_tokens(body), star if phrase is not None else word.endswith("*"), bool(caret)


def _near(query: str, at: int):
    """The phrases of NEAR(...), which lie with at most 10 tokens between the first and the last one, or as many as a
    number after a comma says."""
    leaves, distance = [], 10
    while m := _LEXEME.match(query, at):
        _, first, phrase, _, closes, comma, _, caret, word = m.groups()
        at = m.end()
        if closes:
            leaves = [x for x in leaves if x[1]]
            return (("near", leaves, distance) if len(leaves) > 1 else leaves[0] if leaves else ("term", [], False, False)), at
        if comma:
            number = re.compile(r"\s*(\d+)\s*(?=\))").match(query, at)
            if not number:
                raise QueryError("a number is missing in NEAR")
            distance, at = int(number[1]), number.end()
        elif phrase is not None or word:
            leaves.append(_leaf(phrase, word, first or caret, at < len(query) and query[at] == "*"))
            at += phrase is not None and leaves[-1][2]
        else:
            break
    raise QueryError("NEAR is not closed")


def _either(items):
    left, items = _both(items)
    while items and items[0] == "OR":
        right, items = _both(items[1:])
        left = ("or", left, right)
    return left, items


def _both(items):
    left, items = _one(items)
    while items and items[0] != "OR" and items[0] != ")":
        kind = "not" if items[0] == "NOT" else "and"
        right, items = _one(items[1:] if items[0] in ("AND", "NOT") else items)
        left = right if left is None else left if right is None else (kind, left, right)
    return left, items


def _one(items):
    if not items:
        return None, items
    if items[0] == "(":
        tree, items = _either(items[1:])
        if not items or items[0] != ")":
            raise QueryError("a bracket is not closed")
        return tree, items[1:]
    if isinstance(items[0], str):
        raise QueryError(f"unexpected {items[0]}")
    if items[0][0] == "only":
        tree, rest = _one(items[1:])
        return (tree and ("only", items[0][1], tree)), rest
    return (items[0] if items[0][1] else None), items[1:]


def search(index: DataFrame, key: str, query: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """The keys of the documents that match, each once; none for an empty query. The tokens of the query are filters
    on the index, which a table in the order of write_index turns into skipped row groups. columns are the names of the
    indexed texts, in the order in which they were given to postings()."""
    tree = parse(query, columns)
    if tree is None:
        return index.select(key).limit(0)
    return _match(index, key, tree)


def _match(index: DataFrame, key: str, tree) -> DataFrame:
    """One pass over the postings of all the query's words, then one row for each document that has any of them."""
    wanted, found = [], []
    column, number = F.shiftright("place", COLUMN.bit_length() - 1), F.col("place").bitwiseAND(COLUMN - 1)

    def hit(word: str, prefix: bool, within) -> Column:
        one = F.col("token").startswith(word) if prefix else F.col("token") == word
        return one if within is None else one & column.isin(*within)

    def places(words: list[str], prefix: bool, within, first: bool = False) -> Column:
        """Where a phrase begins."""
        tests = [hit(w, prefix and i + 1 == len(words), within) for i, w in enumerate(words)]
        if first:
            tests[0] &= number == 0
        wanted.extend(tests)
        name = f"_{len(found)}"
        found.append(F.struct(*[F.collect_list(F.when(t, F.col("place") - i)).alias(f"w{i}") for i, t in enumerate(tests)]).alias(name))
        return reduce(F.array_intersect, [F.col(f"{name}.w{i}") for i in range(len(words))])

    def leaf(words: list[str], prefix: bool, first: bool, within) -> Column:
        if len(words) > 1:
            return F.size(places(words, prefix, within, first)) > 0
        one = hit(words[0], prefix, within)
        if first:
            one &= number == 0
        wanted.append(one)
        name = f"_{len(found)}"
        found.append(F.max(one).alias(name))
        return F.coalesce(F.col(name), F.lit(False))

    def near(leaves, distance: int, within) -> Column:
        """Some phrase is the first of a group in which all others begin within the distance of its end."""
        every = [(places(words, prefix, within), len(words)) for _, words, prefix, _ in leaves]

        def leads(k: int) -> Column:
            at, n = every[k]
            return F.exists(at, lambda x: reduce(Column.__and__, [F.exists(to, lambda y: (y >= x) & (y <= x + n + distance)) for j, (to, _) in enumerate(every) if j != k]))
        return reduce(Column.__or__, [leads(k) for k in range(len(every))])

    def test(node, within=None) -> Column:
        if node[0] == "only":
            within = node[1] if within is None else node[1] & within
            return test(node[2], within) if within else F.lit(False)
        if node[0] == "term":
            return leaf(*node[1:], within)
        if node[0] == "near":
            return near(*node[1:], within)
        left, right = test(node[1], within), test(node[2], within)
        return left | right if node[0] == "or" else left & right if node[0] == "and" else left & ~right

    holds = test(tree)
    if not wanted:
        return index.select(key).limit(0)
    return index.filter(reduce(Column.__or__, wanted)).groupBy(key).agg(*found).filter(holds).select(key)


def search_chunks(index: DataFrame, chunks: DataFrame, query: str, limit: int, books: list | None = None, key: str = "chunk_id", book: str = "book_id") -> DataFrame:
    """The first `limit` matching chunks by key. The book filter comes before the limit."""
    if books is not None:
        chunks = chunks.filter(F.col(book).isin(books))
    return chunks.join(search(index, key, query, ("chunk_text",)), key, "left_semi").orderBy(key).limit(limit)


def search_keys(files: DataFrame, query: str, key: str = "key", indexed: bool = True) -> DataFrame:
    """Keys that match the query, or contain it as it is where there is no index or the query is not well formed."""
    if indexed:
        try:
            names = files.select(F.col(key).alias("_key"), key)
            return files.join(search(postings(names, "_key", key), "_key", query, (key,)), F.col(key) == F.col("_key"), "left_semi")
        except QueryError:
            pass
    return files.filter(F.lower(F.col(key)).contains(query.lower()))
