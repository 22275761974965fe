"""Names and references out of bank text: SEPA tags, payment services, card payments, kinds of transactions, and how they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.signals import signal_of
from tallyforge.functions.text import collapse, contains_any, letter_share, normalize_light, repaired, shortened

# Tags of SEPA texts, and patterns of payment services and cards.
TAGS = {"eref": "EREF", "kref": "KREF", "mref": "MREF", "cred": "CRED"}
TAGGED = r"(?i){0}\+([A-Za-z0-9äöüÄÖÜß./?\-\s,]+?)(?:\s+[A-Z]{{4}}\+|$)"
PURPOSE = r"(?i)SVWZ\+(.+?)(?:\s+[A-Z]{4}\+|$)"
ACCOUNT = r"(?i)IBAN\+?:?\s*([A-Z]{2}\d{2}[A-Z0-9]{4,30})"
BANK = r"(?i)BIC\+?:?\s*([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)"
MARKERS = r"(?i)(?:EREF|KREF|MREF|CRED|SVWZ|DEBT|IBAN|BIC)\+[^\s]*\s*"
PAYPAL = [r"[Ii]hr [Ee]inkauf bei\s+(.+?)(?:\s*,\s*Ihr|\s*$)", r"bei\s+([A-Z][^,]{2,30})", r"/PP\.[^/]+/\.?\s*([A-Z][^,]{2,40})", r"\d{10,}/[^,]+,\s*([A-Z][^,]{2,40})"]
VISA = r"(?i)\bvisa\s+(.+?)(?:\s+nr\s+xxxx|\s+kaufumsatz|$)"
CARD = r"(?i)(?:debitkartenzahlung|kartenzahlung)?\s*([A-ZÄÖÜ0-9 .&'\-]+?)//[A-ZÄÖÜa-zäöüß .\-]+/DE"
LEADING = [r"(?i)^(SEPA-?|ÜBERWEISUNG|LASTSCHRIFT|KARTENZAHLUNG)\s*", r"(?i)^(Card payment|Transfer|Direct debit)\s*"]


def found(text: Column, pattern: str) -> Column:
    """The trimmed first group of a pattern; null where it does not match or is empty."""
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


def sepa(text: Column) -> Column:
    """References, account and bank of a SEPA text, and its purpose: what the purpose tag says, else the text without tags."""
    account, bank, purpose = F.upper(found(text, ACCOUNT)), F.upper(found(text, BANK)), found(text, PURPOSE)
    rest = collapse(F.regexp_replace(text, MARKERS, " "))
    tags = [found(text, TAGGED.format(t)).alias(name) for name, t in TAGS.items()]
    return F.struct(*tags, F.when(F.length(account) >= 15, account).alias("iban"), bank.alias("bic"), F.when(F.length(purpose) > 5, purpose).otherwise(rest).alias("purpose"))


def paypal_merchant(text: Column) -> Column:
    """The merchant of a payment service's text; a pattern whose find is too short or a number leaves it to the next."""
    tried = []
    for pattern in PAYPAL:
        name = F.substring(collapse(F.regexp_extract(text, pattern, 1)), 1, 35)
        tried.append(F.when((F.length(name) >= 3) & ~name.rlike(r"^[\d.]+$"), name))
    return F.coalesce(*tried)


def shown_description(text: Column) -> Column:
    for pattern in LEADING:
        text = F.regexp_replace(text, pattern, "")
    text = F.trim(text)
    return F.when(letter_share(text) > 0.5, shortened(text, 70)).otherwise(shortened(text, 50))


def display_name(counterparty: Column, description: Column) -> Column:
    service = F.coalesce(F.lower(counterparty).contains("paypal"), F.lit(False)) | F.coalesce(F.lower(description).contains("paypal"), F.lit(False))
    name = paypal_merchant(description)
    own = F.when((F.trim(counterparty) != "") & (F.length(counterparty) > 2), F.substring(counterparty, 1, 50))
    return F.when(service, F.when(name.isNotNull(), F.concat(F.lit("PayPal · "), name)).otherwise("PayPal")).otherwise(F.coalesce(own, shown_description(description)))


# Patterns of purchases through payment services and of card payments, and what is no part of a merchant's name.
PURCHASES = [
    r"(?i)i\s*hr\s+einkauf\s+b\s*ei\s+(.+?)(?:\s+mandat:|\s+referenz:|/abbuchung|\s+awv-meldepflicht|\s+mref\+|\s+eref\+|$)",
    r"(?i)/\.?\s*([^/]+?),\s*i\s*hr\s+einkauf",
    r"(?i)svwz\+.*?\.\s*([^,]+?),\s*i\s*hr\s+einkauf",
]
CARD_PLACE = r"(?i)(?:debitkartenzahlung|kartenzahlung|lastschrift\s+aus\s+kartenzahlung)?\s*([A-ZÄÖÜ0-9 .&'\-]+?)//[A-ZÄÖÜa-zäöüß .\-]+/DE"
GIROCARD = r"(?i)kartenzahlung\s+girocard.*?\n?\s*([A-ZÄÖÜ0-9 .&'\-]{3,})"
BULLET = r"(?i)(.+?)\s+mastercard\s*•\s*([^\n]+)"
CARD_NOISE = r"(?i)\b(nr|xxxx|kaufumsatz|arn|sagt\s+danke|debitk\.?|kfn|vj|pn)\b|\b\d+[,.]\d+\b|\b\d{2}\.\d{2}\b|\b\d{4,}\b"
LEGAL_FORMS = r"(?i)\b(gmbh|ag|ab|se|s\.?a\.?r\.?l\.?|s\.?c\.?a\.?|unipessoal\s+lda|inc\.?|ltd\.?|bv|a/s|as|co\.?\s*kg)\b"
# Kinds of transactions in order, each with the signal or the parts of a lower-cased text that tell it.
KINDS = [
    ("CASH_WITHDRAWAL", "withdrawal"), ("CASH_DEPOSIT", "deposit"), ("SALARY", "salary"), ("REFUND", "refund"), ("INVESTMENT", "investment"), ("PAYPAL", ["paypal"]), ("VISA_CARD", ["visa"]),
    ("CARD_PAYMENT", ["mastercard", "debitkartenzahlung", "kartenzahlung", "girocard", "debitk"]), ("BANK_FEE", "fee"), ("RENT_OR_UTILITIES", "rent"), ("TRANSFER", "transfer"),
    ("DIRECT_DEBIT", ["lastschrift", "basislastschrift", "sdd lastschr"]),
]
# Categories that a bank's own words hint at.
BANK_HINTS = [
    ("RESTAURANT", ["bars", "restaurants", "restaurant"]), ("HEALTH", ["gesundheit", "droger"]), ("ENTERTAINMENT", ["freizeit", "entertainment"]), ("TRAVEL", ["reisen", "travel", "hotel"]),
    ("SUPERMARKET", ["lebensmittel", "supermarket", "grocery"]),
]
# References that a detail text is shown without.
REFERENCES = [
    r"(?i)Mandat:\s*\S+", r"(?i)Referenz:\s*\S+", r"(?i)Mandatsref\.?:\s*\S+", r"(?i)Gläubiger-?ID:\s*\S+", r"(?i)Creditor-?ID:\s*\S+", r"(?i)End-to-End-?Ref\.?:\s*\S+", r"(?i)EREF:\s*\S+", r"(?i)MREF:\s*\S+", r"(?i)CRED:\s*\S+",
]


def whole_text(*parts: Column) -> Column:
    """All texts of a transaction as one, with torn words put together."""
    return repaired(collapse(F.concat_ws(" ", *parts)))


def kind(low: Column) -> Column:
    """The kind of a transaction, from its lower-cased whole text."""
    out = F.lit("UNKNOWN")
    for name, tell in reversed(KINDS):
        out = F.when(signal_of(tell, low) if isinstance(tell, str) else contains_any(low, tell), name).otherwise(out)
    return out


def clean_merchant(name: Column) -> Column:
    for pattern in (CARD_NOISE, LEGAL_FORMS, r"[.,;:_]+"):
        name = F.regexp_replace(name, pattern, " ")
    return collapse(name)


def effective_merchant(kind_of: Column, counterparty: Column, text: Column) -> Column:
    """Who was paid in the end: by the kind, a name in the whole ``text``, else the counterparty; null below two characters."""
    card = F.coalesce(found(text, CARD_PLACE), found(text, GIROCARD))
    name = (
        F.when(kind_of.isin("PAYPAL", "REFUND"), F.coalesce(*(found(text, p) for p in PURCHASES)))
        .when(kind_of == "VISA_CARD", F.coalesce(found(text, VISA), card))
        .when(kind_of == "CARD_PAYMENT", F.coalesce(found(text, BULLET), card))
        .otherwise(F.when(F.trim(counterparty) != "", counterparty))
    )
    name = clean_merchant(name)
    return F.when(F.length(name) >= 2, name)


def category_hint(text: Column) -> Column:
    """The category that the bank's own words after the card's name hint at, else those of the whole text; null without any."""
    low = F.lower(F.coalesce(F.nullif(F.regexp_extract(text, BULLET, 2), F.lit("")), text))
    out = F.lit(None).cast("string")
    for category, parts in reversed(BANK_HINTS):
        out = F.when(contains_any(low, parts), category).otherwise(out)
    return out


def is_service(counterparty: Column, description: Column) -> Column:
    return F.coalesce(F.lower(counterparty).contains("paypal"), F.lit(False)) | F.coalesce(F.lower(description).contains("paypal"), F.lit(False))


def clean_detail(text: Column) -> Column:
    """A text without references, shortened to 60; null if little of it is letters."""
    for pattern in REFERENCES:
        text = F.regexp_replace(text, pattern, "")
    text = collapse(text)
    return F.when((F.length(text) >= 5) & (letter_share(text) >= 0.3), shortened(text, 60))


def detail_text(description: Column, remittance: Column, counterparty: Column) -> Column:
    """The second line to show: what was bought through a service, else the remittance, else the description's second line."""
    bought = F.nullif(F.regexp_extract(description, r"[Ii]hr [Ee]inkauf bei\s+(.+)", 1), F.lit(""))
    second = F.trim(F.get(F.split(description, r"[\n\r]+"), 1))
    return F.coalesce(
        F.when(is_service(counterparty, description), shortened(bought, 50)),
        F.when((F.trim(remittance) != "") & (F.length(remittance) > 5), clean_detail(remittance)),
        F.when(F.length(second) > 5, clean_detail(second)),
    )


def match_key(counterparty: Column, description: Column) -> Column:
    """What transactions that a user recategorises together have in common."""
    own = F.when(F.trim(counterparty) != "", counterparty)
    return normalize_light(F.when(is_service(counterparty, description), display_name(counterparty, description)).otherwise(F.coalesce(own, description)))
