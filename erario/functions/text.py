"""Text governance as Column expressions (no UDF): accent folding, redaction
of personal data and secrets, sensor counts, message screening, code-fence
stripping, statement / outcome / verdict classification, truncation and BRL
money formatting.

In the reference these steps act on one message at a time, several through an
LLM prompt; here they are deterministic rules over whole text columns, so they
run in the JVM inside whole-stage code generation over any number of rows.
The regular expressions avoid ``\\b`` and look-around so Java and RE2 (the
DuckDB oracle) agree.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# accent folding (NFD, drop combining marks, lower case)
# ---------------------------------------------------------------------------

def _fold_map() -> tuple[str, str]:
    """Every character of the Basic Multilingual Plane whose canonical
    decomposition (NFD) minus combining marks (Mn) is one other character,
    mapped to that character. Built from ``unicodedata`` by rule."""
    src, dst = [], []
    for cp in [c for c in range(0x00C0, 0x10000) if not 0xD800 <= c <= 0xDFFF]:
        ch = chr(cp)
        d = unicodedata.normalize("NFD", ch)
        base = "".join(x for x in d if unicodedata.category(x) != "Mn")
        if d != ch and len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


FOLD_SRC, FOLD_DST = _fold_map()


def accent_fold(col) -> Column:
    """``NFD -> drop Mn -> lower``: 'Saúde' -> 'saude', 'EDUCAÇÃO' -> 'educacao'.
    Decomposed input loses its combining marks; 'ß' and 'ø' stay (NFD does not
    decompose them)."""
    c = _c(col)
    folded = F.lower(F.regexp_replace(F.translate(c, FOLD_SRC, FOLD_DST), r"\p{Mn}", ""))
    # pure ASCII text (as many bytes as characters) has nothing to fold
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(folded)


def contains_folded(col, keyword: str) -> Column:
    """Accent- and case-insensitive substring test (the reference's search)."""
    return F.contains(accent_fold(col), accent_fold(F.lit(keyword)))


# ---------------------------------------------------------------------------
# redaction and sensors
# ---------------------------------------------------------------------------

REDACTED = "[REDACTED]"

# The sensors of the output guardrail (PII: CPF, e-mail, phone,
# card; secrets: API keys, connection strings, internal paths), applied in
# this order; connection strings first, since they contain an e-mail-like
# ``user:password@host``. (name, pattern, keep-prefix groups)
REDACTION_RULES: list[tuple[str, str, bool]] = [
    ("dsn", r"[a-z][a-z0-9+]*://[^ :/@]+:[^ @/]+@[^ ]+", False),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", False),
    ("cpf", r"[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}", False),
    ("api_key", r"sk-[A-Za-z0-9_-]{16,}", False),
    ("secret", r"(token|api_key|secret|password)( *[=:] *)\"?[A-Za-z0-9_/+-]{16,}\"?", True),
    ("path", r"/(home|root|app|etc|var|usr|opt)(/[A-Za-z0-9._-]+)+", False),
    ("card", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", False),
    ("phone", r"\+[0-9]{1,3} ?\([0-9]{2,3}\) ?[0-9]{3,5}-[0-9]{4}", False),
    ("phone_br", r"\([0-9]{2}\) ?9?[0-9]{4}-[0-9]{4}", False),
]

# Literals a rule cannot match without (any of them). A text without them
# skips the regular expression: a byte search instead of a regex scan.
RULE_LITERALS: dict[str, tuple[str, ...]] = {
    "dsn": ("://",), "email": ("@",), "cpf": ("-",), "api_key": ("sk-",),
    "secret": ("token", "api_key", "secret", "password"), "path": ("/",),
    "phone": ("+",), "phone_br": ("(",),
}
# A cheaper pattern that a rule's hits hold, where they have no literal.
RULE_HINTS = {"card": r"[0-9]{4}[ -]?[0-9]{4}", "cpf": r"[0-9]\.[0-9]"}


def _guard(c: Column, name: str, otherwise: Column | None = None) -> Column | None:
    """Whether a text may hold a hit of a rule; ``otherwise`` if that cannot be
    told without searching."""
    if name in RULE_HINTS:
        return c.rlike(RULE_HINTS[name])
    g = otherwise
    for i, literal in enumerate(RULE_LITERALS.get(name, ())):
        h = F.contains(c, F.lit(literal))
        g = h if i == 0 else g | h
    return g


# Rules whose hits carry check digits, with the pattern of a whole candidate: up
# to 16 blocks of four digits may hold a card number at any block.
CHECKED = {"cpf": r"[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}", "card": r"[0-9]{4}([ -]?[0-9]{4}){3,15}"}


def _pattern(rule: tuple[str, str, bool]) -> str:
    return CHECKED.get(rule[0], rule[1])


def _digit(digits: Column, i: int) -> Column:
    return F.substring(digits, i + 1, 1).cast("int")


def cpf_valid(digits) -> Column:
    """The two check digits of an 11-digit CPF (modulus 11); eleven equal digits
    are no CPF."""
    d = _c(digits)

    def check(n: int) -> Column:
        return sum((_digit(d, i) * (n + 1 - i) for i in range(n)), F.lit(0)) * 10 % 11 % 10 == _digit(d, n)

    return check(9) & check(10) & (F.replace(d, F.substring(d, 1, 1), F.lit("")) != "")


def luhn_valid(digits) -> Column:
    """The Luhn sum of a 16-digit card number."""
    d = _c(digits)
    doubled = [_digit(d, i) * 2 for i in range(0, 16, 2)]
    return (sum((x - F.when(x > 9, 9).otherwise(0) for x in doubled), F.lit(0))
            + sum((_digit(d, i) for i in range(1, 16, 2)), F.lit(0))) % 10 == 0


def redact(col, rules: Sequence[tuple[str, str, bool]] = REDACTION_RULES, check_digits: bool = True) -> Column:
    """Replace every sensor hit with ``[REDACTED]``; clean text is unchanged.
    For ``key = value`` secrets the key name is kept: ``token = [REDACTED]``.

    One pass over the text: the leftmost hit of any rule is taken, at one place
    that of the first rule, and the search goes on behind it. Only rules whose
    literals the text holds are searched. With ``check_digits``, a CPF or card
    number without valid check digits stays; blocks of digits in which any four
    blocks in a row are a valid card number go as a whole. NULL stays NULL.
    """
    kept_names = [pat for _, pat, kept in rules if kept]

    def replaced(hit: Column) -> Column:
        digits = F.array(F.regexp_replace(hit, "[ .-]", ""))
        numbers = {"cpf": digits, "card": F.transform(F.sequence(F.lit(1), F.length(digits[0]) - 15, F.lit(4)),
                                                      lambda i: F.substr(digits[0], i, F.lit(16)))}
        valid = {"cpf": F.exists(numbers["cpf"], cpf_valid), "card": F.exists(numbers["card"], luhn_valid)}
        out = F.when(hit.isNull(), F.lit(""))  # behind the last piece
        for pat in kept_names:
            out = out.when(hit.rlike(f"^(?:{pat})$"), F.regexp_replace(hit, f"^(?:{pat})$", "$1$2" + REDACTED))
        for name, *_ in rules:
            if check_digits and name in CHECKED:
                out = out.when(hit.rlike(f"^(?:{CHECKED[name]})$") & ~valid[name], hit)
        return out.otherwise(F.lit(REDACTED))

    def one_pass(t: Column) -> Column:
        wanted = [F.when(_guard(t, rule[0], F.lit(True)), F.lit(_pattern(rule))) for rule in rules]
        # the pattern of a row is a variable, so it is put together once
        return F.transform(F.array(F.concat_ws("|", *wanted)), lambda p: F.when(p == "", t).otherwise(F.array_join(F.zip_with(
            F.split(t, p, -1), F.regexp_extract_all(t, p, F.lit(0)), lambda piece, hit: F.concat(piece, replaced(hit))), "")))[0]

    return F.transform(F.array(_c(col)), one_pass)[0]


def redact_sql(expr: str, rules: Sequence[tuple[str, str, bool]] = REDACTION_RULES) -> str:
    """The same pass as DuckDB SQL (oracle): the hits of all rules, judged one by
    one, between the pieces that they split the text into."""
    every = _sql_str("|".join(_pattern(r) for r in rules))
    keep = _sql_str("^(?:" + "|".join(p for _, p, kept in rules if kept) + ")$")
    digits = "regexp_replace(h, '[ .-]', '', 'g')"
    num = f"list_transform(string_split({digits}, ''), lambda c: c::INTEGER)"
    cpf = " AND ".join(
        f"list_sum(list_transform(range(1, {n + 1}), lambda i: ({n + 2} - i) * ({num})[i])) * 10 % 11 % 10 = ({num})[{n + 1}]"
        for n in (9, 10)) + f" AND len(list_distinct({num})) > 1"
    card = (f"len(list_filter(range(0, len({num}) - 15, 4), lambda s: list_sum(list_transform(range(1, 17), lambda i: "
            f"CASE WHEN i % 2 = 0 THEN ({num})[s + i] WHEN ({num})[s + i] > 4 THEN 2 * ({num})[s + i] - 9 "
            f"ELSE 2 * ({num})[s + i] END)) % 10 = 0)) > 0")
    hit = (f"CASE WHEN regexp_matches(h, '{keep}') THEN regexp_replace(h, '{keep}', '\\1\\2{REDACTED}') "
           f"WHEN regexp_full_match(h, '{_sql_str(CHECKED['cpf'])}') AND NOT ({cpf}) THEN h "
           f"WHEN regexp_full_match(h, '{_sql_str(CHECKED['card'])}') AND NOT ({card}) THEN h ELSE '{REDACTED}' END")
    return (f"list_reduce(list_transform(list_zip(string_split_regex({expr}, '{every}'), "
            f"list_transform(regexp_extract_all({expr}, '{every}'), lambda h: {hit})), "
            f"lambda z: z[1] || coalesce(z[2], '')), lambda a, b: a || b)")


def sensor_counts(col, rules: Sequence[tuple[str, str, bool]] = REDACTION_RULES) -> list[Column]:
    """One count column per sensor: hits in the original text."""
    out = []
    for name, pat, _ in rules:
        cnt = F.regexp_count(_c(col), F.lit(pat))
        g = _guard(_c(col), name)
        out.append((cnt if g is None else F.when(g, cnt).otherwise(F.lit(0))).alias(f"n_{name}"))
    return out


def _sql_str(s: str) -> str:
    return s.replace("'", "''")


# ---------------------------------------------------------------------------
# message screening
# ---------------------------------------------------------------------------

def _words(*ws: str) -> str:
    """Match any of ``ws`` as whole words (no ``\\b``: Java and RE2 agree)."""
    return r"(^|[^a-z0-9])(" + "|".join(ws) + r")([^a-z0-9]|$)"


# The input guardrail's policy as rules over folded text.
# Destructive SQL, jailbreak phrases, dangerous content and out-of-scope
# topics are UNSAFE; everything else (greetings included) is SAFE.
SCREEN_RULES: list[tuple[str, str]] = [
    ("destructive_sql", r"(drop|delete|truncate|alter|apague|apagar|exclua|excluir|deletar)"
                        r" +(all +|todas +as +|todos +os +|the +|a +|o +)?"
                        r"(table|tables|tabela|tabelas|database|banco|schema|rows|registros|from)"),
    ("sql_write", r"(insert +into|update +[a-z_]+ +set|grant +all|create +table)"),
    ("jailbreak", r"(ignore|disregard|ignorar|ignore +as|esqueca) +(all +|todas +as +|the +|your +|suas +)?"
                  r"(previous|prior|above|anteriores|instructions|instrucoes|rules|regras)"),
    ("jailbreak_role", r"(you +are +now|developer +mode|jailbreak|pretend +to +be|finja +ser|modo +desenvolvedor)"),
    ("dangerous", _words("bomb", "bomba", "explosive", "explosivo", "weapon", "arma")),
    ("out_of_scope", _words("poem", "poema", "poesia", "recipe", "cake", "bolo", "chocolate", "football",
                            "futebol", "soccer", "joke", "piada", "song", "musica")),
]


def screen_hits(col, rules: Sequence[tuple[str, str]] = SCREEN_RULES) -> Column:
    """Comma-joined names of the rules a message triggers ('' if none). The text
    is folded once, as the variable that every rule reads."""
    return F.transform(F.array(accent_fold(col)), lambda t: F.concat_ws(
        ",", *[F.when(t.rlike(p), F.lit(n)) for n, p in rules]))[0]


def verdict_of(hits: Column) -> Column:
    """'UNSAFE' if any rule fired, else 'SAFE' (fail-open, as the reference)."""
    return F.when(hits != "", F.lit("UNSAFE")).otherwise(F.lit("SAFE"))


def screen_verdict(col, rules: Sequence[tuple[str, str]] = SCREEN_RULES) -> Column:
    """The verdict alone; with the hits at hand use ``verdict_of``."""
    return verdict_of(screen_hits(col, rules))


def screen_sql(expr: str, rules: Sequence[tuple[str, str]] = SCREEN_RULES) -> tuple[str, str]:
    """(verdict, hits) as DuckDB SQL over ``lower(strip_accents(expr))``."""
    f = f"lower(strip_accents({expr}))"
    conds = [f"regexp_matches({f}, '{_sql_str(p)}')" for _, p in rules]
    verdict = f"CASE WHEN {' OR '.join(conds)} THEN 'UNSAFE' ELSE 'SAFE' END"
    hits = "concat_ws(',', " + ", ".join(
        f"CASE WHEN {c} THEN '{n}' END" for (n, _), c in zip(rules, conds)) + ")"
    return verdict, hits


# ---------------------------------------------------------------------------
# code fences, statements, outcomes, verdicts
# ---------------------------------------------------------------------------

#: What Python's ``str.strip()`` removes (fixed value).
BLANKS = "\\x09-\\x0d\\x1c-\\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WS = f"^[{BLANKS}]+|[{BLANKS}]+$"


def py_strip(col) -> Column:
    """Python ``str.strip()``: all surrounding whitespace, not only spaces."""
    return F.regexp_replace(_c(col), _WS, "")


def strip_code_fence(col, anywhere: bool = False) -> Column:
    """Trim; drop a leading ```` ```python ```` or ```` ``` ```` and a trailing
    ```` ``` ````; trim again. ``anywhere=True`` is the SQL variant: every
    ```` ```sql ```` / ```` ``` ```` fence is removed wherever it is."""
    if anywhere:
        return py_strip(F.regexp_replace(_c(col), r"```(sql)?", ""))
    s = py_strip(col)
    s = F.regexp_replace(s, r"^```(python)?", "")
    s = F.regexp_replace(s, r"```$", "")
    return py_strip(s)


def is_readonly_select(col) -> Column:
    """The reference's read-only gate: trimmed, upper-cased text starts with
    SELECT."""
    return F.startswith(F.upper(py_strip(col)), F.lit("SELECT"))


def classify_outcome(col) -> Column:
    """'error' if the output starts with 'Execution Error' / 'System Error' or
    contains 'Traceback', else 'ok'."""
    c = _c(col)
    err = F.startswith(c, F.lit("Execution Error")) | F.startswith(c, F.lit("System Error")) | \
        F.contains(c, F.lit("Traceback"))
    return F.when(err, F.lit("error")).otherwise(F.lit("ok"))


def parse_verdict(col) -> Column:
    """struct(verdict, target, reason) of a reviewer answer:
    'APPROVE' or 'REJECT [CODE|PLAN]: reason'. REJECT is a substring test, as
    in the reference; the target and reason are optional. The reason is all that
    follows, over several lines."""
    c = _c(col)
    rej = F.contains(F.upper(c), F.lit("REJECT"))
    target = F.regexp_extract(c, r"REJECT *\[(CODE|PLAN)\]", 1)
    reason = F.regexp_extract(c, r"(?s)REJECT *(\[[A-Z]+\])? *:? *(.*)$", 2)
    verdict = F.when(rej, F.lit("REJECT")).when(F.contains(F.upper(c), F.lit("APPROVE")), F.lit("APPROVE"))
    return F.struct(verdict.alias("verdict"),
                    F.when(rej & (target != ""), target).alias("target"),
                    F.when(rej & (reason != ""), reason).alias("reason"))


# ---------------------------------------------------------------------------
# truncation and money text
# ---------------------------------------------------------------------------

TRUNCATION_MARK = "... [TRUNCATED]"


def truncate_marked(col, n: int = 2000) -> Column:
    """First ``n`` characters plus a marker when the text is longer."""
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(TRUNCATION_MARK))).otherwise(c)


def format_brl(col) -> Column:
    """``R$ 1.234,56``; the sign goes first (``-R$ 50.000,00``); two decimals,
    rounded once on the cast to decimal(18,2)."""
    d = _c(col).cast("decimal(18,2)")
    body = F.translate(F.format_number(F.abs(d), 2), ",.", ".,")
    return F.concat(F.when(d < 0, F.lit("-")).otherwise(F.lit("")), F.lit("R$ "), body)
