"""The category of a transaction by a cascade of rules, as one Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.signals import SIGNALS
from tallyforge.functions.text import contains_any, pattern_of

# The categories.
CATEGORIES = ["RENT", "TRANSPORT", "SUPERMARKET", "RESTAURANT", "SHOPPING", "HEALTH", "INSURANCE", "ENTERTAINMENT", "SUBSCRIPTIONS", "INVESTMENT", "TRAVEL", "SALARY", "REFUND", "TRANSFER", "EDUCATION", "TAXES", "OTHER"]
# Their names in English and German.
NAMES = {
    "RENT": ("Rent & Utilities", "Miete & Nebenkosten"), "TRANSPORT": ("Transport", "Transport"), "SUPERMARKET": ("Supermarket", "Supermarkt"), "RESTAURANT": ("Restaurant", "Restaurant"),
    "SHOPPING": ("Shopping", "Einkaufen"), "HEALTH": ("Health", "Gesundheit"), "INSURANCE": ("Insurance", "Versicherung"), "ENTERTAINMENT": ("Entertainment", "Unterhaltung"),
    "SUBSCRIPTIONS": ("Subscriptions", "Abonnements"), "INVESTMENT": ("Investment", "Investition"), "TRAVEL": ("Travel", "Reisen"), "SALARY": ("Salary", "Gehalt"), "REFUND": ("Refund", "Rückerstattung"),
    "TRANSFER": ("Transfer", "Überweisung"), "EDUCATION": ("Education", "Bildung"), "TAXES": ("Taxes", "Steuern"), "OTHER": ("Other", "Sonstiges"),
}
# Least probability of a model's category, by how far a user lets it go.
MODES = {"SAFE": None, "BALANCED": 0.30, "EXPERIMENTAL": 0.20}
# Parts of lower-cased texts that decide a category, in order.
STRONG_TEXT = [
    ("SUBSCRIPTIONS", ["google *youtubepremium", "google youtubepremium", "youtube premium", "youtube super", "google youtube", "apple services", "apple service", "google one", "netflix", "spotify", "drillisch", "winsim", "lagoa yoga"]),
    ("TRAVEL", ["hotel", "airbnb", "booking.com", "lufthansa", "easyjet", "ryanair", "eurowings", "condor", "airline", "airways", "airport", "flug", "flight"]),
    ("TRANSPORT", ["db vertrieb", "db vertr ieb", "deutsche bahn", "bahn.de", "bvg", "berliner verkehrsbetriebe", "s-bahn", "s bahn", "logpay financial services", "flix se", "gmsa guaguas"]),
    ("RENT", ["commerzbank ag leistungen", "tilgung", "zinsen", "telekom deutschland", "enstroga", "strom", "gehag", "miete01"]),
    ("SUPERMARKET", ["hiperdino", "ullrich", "c+c mercado", "flaschenpost", "bamut markt", "frischeparadies", "reformhaus", "go asia", "alnatura", "bio company"]),
    ("SHOPPING", ["ikea", "bauhaus", "obi", "hornbach", "toom", "hobbyshop", "hobby shop", "dm drogerie", "dm-drogerie", "dm drogerie markt", "drogerie markt", "rossmann", "butlers", "amazon payments", "amzn mktp", "ebay", "alipay", "deutsche post", "post ag", "otrium", "ic group", "tantal", "breuninger", "schuhhandelsgesellschaft", "google play", "google payment", "el corte ingles", "wdfg", "cos berlin", "muji"]),
    ("ENTERTAINMENT", ["fienta", "ticket messe"]),
    ("HEALTH", ["apotheke", "krankenkasse", "bkk", "aok", "tk ", "barmer"]),
    ("INSURANCE", ["krankenversicherung", "versicherung", "verti", "allianz", "debeka", "generali", "huk", "axa"]),
    ("RESTAURANT", ["takeaway", "drei koche", "sticknsushi", "restaurant kuchi", "burger king", "sironi backerei", "19 grams", "la tapatica", "granier", "allende", "bar perdomo"]),
    ("TRANSFER", ["money transfer", "paypal payment", "paypal transfer", "db verti eb", "extra-konto", "extra konto", "ueberweisung", "überweisung", "umbuchung", "transfer"]),
]
# Kind of text, category, confidence, and the sign of amounts it needs (0: any).
STRONG_SIGNALS = [
    ("salary", "SALARY", 0.95, 0), ("refund", "REFUND", 0.88, 0), ("investment", "INVESTMENT", 0.90, 0), ("travel", "TRAVEL", 0.88, 0), ("withdrawal", "TRANSFER", 0.85, 0), ("deposit", "TRANSFER", 0.85, 0),
    ("fee", "OTHER", 0.70, 0), ("transfer", "TRANSFER", 0.85, -1), ("rent", "RENT", 0.88, -1), ("rent", "REFUND", 0.80, 1),
]
TEXT_CONFIDENCE, MERCHANT_CONFIDENCE, MERCHANT_KEYWORD_CONFIDENCE, HINT_CONFIDENCE, KEYWORD_CONFIDENCE = 0.88, 0.90, 0.82, 0.78, 0.75
GATE, SALARY_CENTS = 0.80, 30_000


def _result(category: Column | str, confidence: float, source: str) -> Column:
    category = F.lit(category) if isinstance(category, str) else category
    return F.struct(category.alias("category"), F.lit(confidence).cast("double").alias("confidence"), F.lit(source).alias("source"))


def cascade(
    low: Column, amount: Column, override: Column | None = None, merchant: Column | None = None, keyword: Column | None = None, hint: Column | None = None, merchant_keyword: Column | None = None
) -> Column:
    """Category, confidence and source of the first rule that fits.

    ``low`` is the lower-cased text, best a column of its own, so that it is made once a row.  The others are categories
    that joins have found, null where they found none: of a user's ``override``, of the ``merchant``, of keywords in the
    merchant's name, of the bank's ``hint``, of keywords in the whole text.
    """
    strong = [(contains_any(low, parts), _result(c, TEXT_CONFIDENCE, "SIGNAL_RULE")) for c, parts in STRONG_TEXT]
    for kind, category, confidence, sign in STRONG_SIGNALS:
        fits = contains_any(low, SIGNALS[kind])
        strong.append((fits if not sign else fits & ((amount > 0) if sign > 0 else (amount < 0)), _result(category, confidence, "SIGNAL_RULE")))
    rules = []
    joined = ((merchant, MERCHANT_CONFIDENCE, "MERCHANT"), (merchant_keyword, MERCHANT_KEYWORD_CONFIDENCE, "KEYWORD"), (hint, HINT_CONFIDENCE, "SIGNAL_RULE"), (keyword, KEYWORD_CONFIDENCE, "KEYWORD"))
    rules += [(c.isNotNull(), _result(c, confidence, source)) for c, confidence, source in joined if c is not None]
    rules += [(amount > SALARY_CENTS, _result("SALARY", 0.55, "SIGNAL_RULE")), (amount > 0, _result("REFUND", 0.65, "SIGNAL_RULE"))]
    weak = _chain(rules, _result("OTHER", 0.0, "UNKNOWN"))
    parts = [p for _, own in STRONG_TEXT for p in own] + [p for kind, *_ in STRONG_SIGNALS for p in SIGNALS[kind]]
    found = F.when(low.rlike(pattern_of(parts)), _chain(strong, weak)).otherwise(weak)  # most texts have none of all these parts
    return found if override is None else F.when(override.isNotNull(), _result(override, 1.0, "USER_OVERRIDE")).otherwise(found)


def _chain(rules: list[tuple[Column, Column]], found: Column) -> Column:
    for fits, result in reversed(rules):
        found = F.when(fits, result).otherwise(found)
    return found


def gated(found: Column) -> Column:
    """A cascade's result as it is stored: unsure categories become suggestions."""
    sure = (found["confidence"] >= GATE) | (found["source"] == "USER_OVERRIDE")
    suggested = F.when(~sure & (found["source"] != "UNKNOWN"), found["category"])
    return F.struct(F.when(sure, found["category"]).otherwise("OTHER").alias("category"), found["confidence"].alias("confidence"), found["source"].alias("source"), suggested.alias("suggested"))


def with_model(found: Column, label: Column, probability: Column, mode: str) -> Column:
    """A stored result with the model's say where the rules have none: its label if it is sure enough for the ``mode``, else as a suggestion."""
    least = MODES[mode]
    if least is None:
        return found
    asked = (found["category"] == "OTHER") & label.isNotNull() & (label != "OTHER")
    taken = F.struct(label.alias("category"), probability.alias("confidence"), F.lit("ML").alias("source"), F.lit(None).cast("string").alias("suggested"))
    hinted = F.struct(found["category"].alias("category"), found["confidence"].alias("confidence"), found["source"].alias("source"), label.alias("suggested"))
    return F.when(asked & (probability >= least), taken).when(asked, hinted).otherwise(found)


def category_name(category: Column, german: bool = False) -> Column:
    """A category's name; that of OTHER if it is none."""
    names = F.create_map(*(F.lit(x) for c, both in NAMES.items() for x in (c, both[german])))
    return F.coalesce(F.try_element_at(names, category), F.lit(NAMES["OTHER"][german]))


def identified(identifier: Column) -> Column:
    """What ``predefined:<category>``, ``custom:<id>`` or a bare name stand for: a category, else an id, else a custom name."""
    bare = F.regexp_replace(identifier, "^predefined:", "")
    known = F.when(bare.isin(CATEGORIES), bare)
    number = F.nullif(F.regexp_extract(identifier, r"^custom:(\d+)$", 1), F.lit("")).cast("long")
    name = F.when(known.isNull() & ~identifier.startswith("predefined:") & ~identifier.startswith("custom:"), identifier)
    return F.struct(known.alias("category"), number.alias("custom_id"), name.alias("custom_name"))
