"""Small text functions: first non-empty value, extensions, domains, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns], F.lit(""))


def extension(name: Column) -> Column:
    """Word characters after the last dot at the end, lower-cased; empty without."""
    return F.lower(F.regexp_extract(name, r"\.(\w+)$", 1))


def extension_live(name: Column) -> Column:
    """What follows the last dot, lower-cased; empty without a dot."""
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def email_domain(address: Column) -> Column:
    """The domain of an address by its first @, null without."""
    return F.nullif(F.regexp_extract(address, r"@([\w.-]+)", 1), F.lit(""))


def domain_after_last(address: Column) -> Column:
    return F.when(address.contains("@"), F.lower(F.substring_index(address, "@", -1))).otherwise("")


def external_recipients(to: Column, company: Column) -> Column:
    """Training dialect: recipients between semicolons that don't contain the company's domain; null counts none."""
    return F.when(to.isNull(), 0).otherwise(F.size(F.filter(F.split(to, ";"), lambda r: ~F.lower(r).contains(company))))


def any_external(to: Column, sender: Column, split: bool = False) -> Column:
    """0 or 1: an address of another domain than the sender's; the live dialect takes the text as one address."""
    own = domain_after_last(sender)
    parts = F.split(F.coalesce(to, F.lit("")), ";") if split else F.array(F.coalesce(to, F.lit("")))
    return F.exists(parts, lambda r: r.contains("@") & (domain_after_last(F.trim(r)) != own)).cast("int")


def number_or_zero(text: Column) -> Column:
    """A whole number of a text, 0 for anything else."""
    return F.coalesce(text.try_cast("int"), F.lit(0))


def anonymous(value: Column, salt: str, prefix: str = "USR-") -> Column:
    """The prefix and the first eight hex digits of a salted SHA-256, in capitals."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), value), 256), 1, 8)))


def anonymise(tables: dict[str, DataFrame], users: dict[str, list[str]], salt: str, prefix: str = "USR-") -> dict[str, DataFrame]:
    """The tables with the named columns of each made anonymous in the same way, so that rows that met before still meet; null stays null."""
    return {name: df.withColumns({c: anonymous(F.col(c), salt, prefix) for c in users.get(name, [])}) for name, df in tables.items()}


def is_identity(user: Column) -> Column:
    """Names that stand for someone: not blank, unknown, hidden, a bare number or a raw key or role id."""
    return (
        user.isNotNull() & (user != "") & ~user.isin("?", "HIDDEN_DUE_TO_SECURITY_REASONS") & ~user.rlike("^[0-9]+$") & ~user.startswith("AIDA") & ~user.startswith("AROA")
    )


def cloud_user(user_name: Column, issuer: Column, principal: Column, kind: Column) -> Column:
    """A stable name: user name, session issuer, the session's name if it isn't a number or long, else the kind."""
    session = F.when(principal.contains(":"), principal.substr(F.locate(":", principal) + 1, F.length(principal)))
    plain = F.when((session != "") & ~session.rlike("^[0-9]+$") & (F.length(session) < 40), session)
    return first_filled(user_name, issuer, plain, kind)
