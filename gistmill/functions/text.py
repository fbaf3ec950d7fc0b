"""Text functions as Column expressions."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of secrets and what replaces them, applied in this order.
SECRETS: list[tuple[str, str]] = [
    (r"(?i)\b(sk|pk)-[A-Za-z0-9_\-]{20,}", "[KEY]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[AWS_KEY]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", "[GH_TOKEN]"),
    (r"\bAIza[0-9A-Za-z_\-]{35}\b", "[GOOGLE_KEY]"),
    (r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}", "[JWT]"),
    (r"(?i)(bearer|authorization:)\s+\S+", "$1 [REDACTED]"),
    (r"(?i)\b(\w*(?:secret|token|password|passwd|api[_-]?key|credential|private[_-]?key|access[_-]?key)\w*)\s*[=:]\s*\S+", "$1=[REDACTED]"),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[PRIVATE_KEY]"),
    (r"://[^:/\s]+:[^@/\s]+@", "://[CRED]@"),
]
SENSITIVE_KEY = r"(?i)(secret|token|password|passwd|api[_-]?key|credential|private[_-]?key|access[_-]?key|authorization)"
# One letter to one letter, and one letter to several.
CYRILLIC_ONE = ("абвгдеёзийклмнопрстуфыэўқғҳ", "abvgdeeziyklmnoprstufyeuqgh")
CYRILLIC_MORE = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya", "ъ": "", "ь": ""}


#: What a client takes out before it sends a text: the same, and tokens of one kind by their exact length first; fixed values.
CLIENT_SECRETS = [*SECRETS[:2], (r"\bghp_[A-Za-z0-9]{36}\b", "[GH_TOKEN]"), *SECRETS[2:]]


def _any(secrets: list[tuple[str, str]]) -> str:
    """Whether a text may hold any secret: one pass, so that the others cost no more."""
    return "|".join(f"(?:{pattern})" for pattern, _ in secrets)


#: What every secret holds, whatever its case: a text without any of it is not searched for whole ones.  All of a tuple's parts are needed.
_HINTS = [("k-",), ("akia",), ("gh", "_"), ("aiza",), ("eyj",), ("bearer",), ("authorization:",), ("secret",), ("token",), ("passw",), ("key",), ("credential",), ("://",)]
_HINT = r"(?i)k-|AKIA|gh[pousr]_|AIza|eyJ|bearer|authorization:|secret|token|passw|api[_-]?key|private[ _-]?key|access[_-]?key|credential|://"


def may_hold(text: Column) -> Column:
    """Whether a text may hold any secret, by letters that each of them has; plain searches tell of most texts that they hold none."""
    found = bound(F.lower(text), lambda x: functools.reduce(operator.or_, [functools.reduce(operator.and_, [F.contains(x, F.lit(y)) for y in parts]) for parts in _HINTS]))
    return found & text.rlike(_HINT)


def _holds(text: Column, secrets: list[tuple[str, str]]) -> Column:
    whole = text.rlike(_any(secrets))
    return may_hold(text) & whole if secrets in (SECRETS, CLIENT_SECRETS) else whole


def redact(text: Column, secrets: list[tuple[str, str]] = SECRETS) -> Column:
    out = text
    for pattern, by in secrets:
        out = F.regexp_replace(out, pattern, by)
    return F.when(_holds(text, secrets), out).otherwise(text)


def redactions(text: Column, secrets: list[tuple[str, str]] = SECRETS) -> Column:
    """How many secrets ``redact`` replaces; each step counts in what the steps before have left."""
    n, left = F.lit(0), text
    for pattern, by in secrets:
        n = n + F.regexp_count(left, F.lit(pattern))
        left = F.regexp_replace(left, pattern, by)
    return F.when(_holds(text, secrets), n).otherwise(F.when(text.isNotNull(), 0))


def _redacted(text: Column, secrets: list[tuple[str, str]] = SECRETS) -> Column:
    """A struct of text and n, the redacted text and the number of redactions, each step worked out once from the one before; for texts inside lambdas, where nothing else shares work."""
    def step(pattern: str, by: str) -> Callable[[Column], Column]:
        return lambda s: F.when(s["text"].rlike(pattern), F.struct(F.regexp_replace(s["text"], pattern, by).alias("text"), (s["n"] + F.regexp_count(s["text"], F.lit(pattern))).alias("n"))).otherwise(s)

    state = F.struct(text.alias("text"), F.lit(0).alias("n"))
    for pattern, by in secrets:
        state = bound(state, step(pattern, by))
    return state


def redact_map(values: Column) -> Column:
    """A map of strings: values under sensitive keys go, the others are redacted."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(SENSITIVE_KEY), F.lit("[REDACTED]")).otherwise(redact(v)))


#: Code points that count as white space, as ranges.
WHITE = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
_WHITE = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in WHITE) + "]+"
#: Lower-case letters whose folding is another one or more; by Python's rule for all letters.
FOLDED = {c: c.casefold() for c in map(chr, range(0x20000)) if c.lower() == c != c.casefold()}
_ONE = {c: f for c, f in FOLDED.items() if len(f) == 1}
_MORE = {c: f for c, f in FOLDED.items() if len(f) > 1}
#: Those of them that texts in Latin letters hold.
_LATIN = {c: f for c, f in FOLDED.items() if ord(c) < 0x100}


def _ranges(letters: list[str], gap: int = 0x80) -> str:
    """A character class of a few ranges that holds all of the letters, and others between."""
    out: list[list[int]] = []
    for code in sorted(map(ord, letters)):
        if out and code - out[-1][1] <= gap:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out) + "]"


_BEYOND_LATIN = _ranges([c for c in FOLDED if c not in _LATIN])
_ANY_FOLDED = f"[{''.join(_LATIN)}\\x{{{min(ord(c) for c in FOLDED if c not in _LATIN):X}}}-\\x{{10FFFF}}]"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, wherever f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def casefolded(text: Column) -> Column:
    """Unicode's full case folding.

    Two tests of a few ranges tell which texts need more than lower case: most need nothing, texts in Latin letters two replacements, and only the
    others a pass over all letters that fold.
    """

    def folded(x: Column) -> Column:
        latin = x
        for letter, by in _LATIN.items():
            latin = F.replace(latin, F.lit(letter), F.lit(by))
        rest = F.translate(x, "".join(_ONE), "".join(_ONE.values()))
        for letter, by in _MORE.items():
            rest = F.replace(rest, F.lit(letter), F.lit(by))
        return F.when(~x.rlike(_ANY_FOLDED), x).when(~x.rlike(_BEYOND_LATIN), latin).otherwise(rest)

    return bound(F.lower(text), folded)


def normalised(text: Column) -> Column:
    """Case-folded, with each run of white space as one space, and none at the ends."""
    return casefolded(F.trim(F.regexp_replace(text, _WHITE, " ")))


def stripped(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, f"^{_WHITE}|{_WHITE}$", "")


def stripped_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WHITE}|{_WHITE}$', '', 'g')"


def casefolded_sql(x: str) -> str:
    """The same for DuckDB."""
    out = f"translate(lower({x}), '{''.join(_ONE)}', '{''.join(_ONE.values())}')"
    for letter, by in _MORE.items():
        out = f"replace({out}, '{letter}', '{by}')"
    return out


def normalised_sql(x: str) -> str:
    return casefolded_sql(f"trim(regexp_replace({x}, '{_WHITE}', ' ', 'g'))")


def redacted_sql(x: str, secrets: list[tuple[str, str]] = SECRETS) -> tuple[str, str]:
    """Redacted text and number of redactions for DuckDB, each step on what the steps before have left."""
    counts = []
    for pattern, by in secrets:
        counts.append(f"len(regexp_extract_all({x}, '{pattern}'))")
        by = by.replace("$1", "\\1")
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x, " + ".join(counts)


def content_hash(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


#: What JSON consists of once its escaped quotes are out of the way: a string, with the colon behind it if it is a key, or what stands between strings.
_JSON_TOKEN = r'("[^"]*"\s*:?|[^"]+)'
#: Escapes that hide quotes, and control characters, which JSON never holds as such, that stand for them meanwhile.
_ESCAPES = {"\\\\": "\x01", '\\"': "\x02"}


def redact_json(json: Column) -> Column:
    """A struct of json and count: a JSON text of any shape with all strings redacted, keys too, and with what was replaced.

    A string that is not empty is replaced whole under a sensitive key; numbers, truth values and nulls stay as they are, and objects and lists are gone into whatever
    their key.  Strings are found in one pass over the text, at any depth; what is no JSON gives null.
    """
    mark, hiding = '"[REDACTED]"', json
    for escape, by in _ESCAPES.items():
        hiding = F.replace(hiding, F.lit(escape), F.lit(by))

    def plain(t: Column) -> Column:
        for escape, by in _ESCAPES.items():
            t = F.replace(t, F.lit(by), F.lit(escape))
        return t

    def cleaned(tokens: Column) -> Column:
        def token(hidden_t: Column, i: Column) -> Column:
            before = F.get(tokens, i - 1)
            # the key's colon stands in the token right before its string; white space may stand between
            key = F.when(F.trim(before) == "", F.get(tokens, i - 2)).otherwise(before)
            named = F.coalesce(F.endswith(key, F.lit(":")) & F.startswith(key, F.lit('"')) & plain(key).rlike(SENSITIVE_KEY), F.lit(False))

            def text_of(t: Column) -> Column:
                is_key = F.endswith(t, F.lit(":"))
                quoted = F.when(is_key, F.regexp_replace(t, r"\s*:$", "")).otherwise(t)
                return bound(quoted, lambda q: said_of(t, is_key, q))

            def said_of(t: Column, is_key: Column, quoted: Column) -> Column:
                # a string without escapes says what stands between its quotes
                said = F.when(F.contains(quoted, F.lit("\\")), F.try_variant_get(F.try_parse_json(quoted), "$", "string")).otherwise(F.substring_index(F.substr(quoted, F.lit(2)), '"', 1))
                return bound(said, lambda s: F.when(~is_key & named & (s != ""), F.struct(F.lit(mark).alias("token"), F.lit(1).alias("n"))).when(may_hold(s), changed(t, is_key, quoted, s)).otherwise(same(t)))

            def changed(t: Column, is_key: Column, quoted: Column, said: Column) -> Column:
                def told(x: Column) -> Column:
                    again = F.regexp_replace(F.to_json(F.array(x["text"])), r"^\[|\]$", "")
                    tail = F.when(is_key, F.substr(t, F.length(quoted) + 1)).otherwise(F.lit(""))
                    return F.struct(F.when(x["n"] > 0, F.concat(again, tail)).otherwise(t).alias("token"), x["n"].alias("n"))

                return bound(_redacted(said), told)

            return F.when(F.startswith(hidden_t, F.lit('"')), bound(plain(hidden_t), text_of)).otherwise(same(plain(hidden_t)))

        return F.transform(tokens, token)

    def same(t: Column) -> Column:
        return F.struct(t.alias("token"), F.lit(0).alias("n"))

    parts = bound(F.regexp_extract_all(hiding, F.lit(_JSON_TOKEN), 1), cleaned)
    out = bound(parts, lambda p: F.struct(F.array_join(F.transform(p, lambda x: x["token"]), "").alias("json"), F.aggregate(p, F.lit(0), lambda n, x: n + x["n"]).alias("count")))
    return F.when(F.try_parse_json(json).isNotNull(), out)


def slug(text: Column, fallback: str = "entity", size: int = 63) -> Column:
    x = casefolded(F.trim(text))
    for letter, by in CYRILLIC_MORE.items():
        x = F.replace(x, F.lit(letter), F.lit(by))
    x = F.translate(x, *CYRILLIC_ONE)
    x = F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(x == "", F.lit(fallback)).otherwise(F.substring(x, 1, size))


def terms(text: Column, most: int = 32) -> Column:
    """Distinct case-folded search terms, in order of first sight."""
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?U)([\w./:@#-]+)"), 1), casefolded)), 1, most)


def is_identifier(term: Column) -> Column:
    return term.rlike(r"[0-9./:@#_-]") | ((F.length(term) > 1) & (F.upper(term) == term) & (F.lower(term) != term))


def identifiers(text: Column, most: int = 16) -> Column:
    """Terms that name something exactly: with a digit or a mark, or in capitals."""
    return F.slice(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"(?U)([\w./:@#-]+)"), 1), is_identifier)), 1, most)


def token_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]")))


def span(text: Column, start: Column, end: Column) -> Column:
    """Characters from start, from 0, up to end."""
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))


def span_holds(text: Column, start: Column, end: Column, digest: Column) -> Column:
    """Whether the cited span still has the digest that was cited."""
    return F.sha2(span(text, start, end).cast("binary"), 256) == digest


def unique_offset(text: Column, quote: Column) -> Column:
    """Offset from 0 of a quote that occurs exactly once; null otherwise."""
    at = F.instr(text, quote)
    again = F.position(quote, text, at + 1)
    return F.when((at > 0) & (again == 0), at - 1)


#: Characters of an assistant's turn that a prompt shows, and the mark behind them; fixed values.
SHOWN, SHOWN_MARK = 220, " […truncated]"


def shortened(text: Column, size: int = SHOWN, mark: str = SHOWN_MARK) -> Column:
    """The first characters, without white space at their end, and a mark, of a longer text."""
    return F.when(F.length(text) > size, F.concat(F.regexp_replace(F.substring(text, 1, size), f"{_WHITE}$", ""), F.lit(mark))).otherwise(text)


def window(text: Column, start: Column, end: Column, size: Column | int) -> Column:
    """A struct of low and high: the place of about ``size`` characters in all around a span, cut between words where a space allows it, never within the span."""
    size = F.lit(size) if isinstance(size, int) else size
    extra = F.floor(F.greatest(size - (end - start), F.lit(0)) / 2).cast("int")
    low, high = F.greatest(start - extra, F.lit(0)), F.least(end + extra, F.length(text))
    gap = F.instr(F.substr(text, low + 1, start - low), " ")
    tail = F.reverse(F.substr(text, end + 1, high - end))
    back = F.instr(tail, " ")
    low = F.when((low > 0) & (gap > 0), low + gap).otherwise(low)
    high = F.when((high < F.length(text)) & (back > 0), high - back).otherwise(high)
    whole = (size <= 0) | ((start == 0) & (end >= F.length(text)))
    return F.struct(F.when(whole, start).otherwise(low).cast("int").alias("low"), F.when(whole, end).otherwise(high).cast("int").alias("high"))


def surrounding(text: Column, start: Column, end: Column, size: Column | int) -> Column:
    """The words around a span of a text."""
    return bound(window(text, start, end, size), lambda w: span(text, w["low"], w["high"]))
