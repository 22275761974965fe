"""Which bank a document is from: identifiers in tiers, and a choice that is refused where it is not clear.

Identifiers are rows of a small table.  One pass over the lines finds which of them a document has; counts by bank and tier
make a score, and the two best scores of a document decide.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import pattern_of
from tallyforge.plans import views
from tallyforge.plans.catalog import query


@dataclass(frozen=True)
class Bank:
    """``style`` says what the identifiers are worth.

    ``tiers``: one certain 100; two high, or one and a medium, 75; one high or two medium 50; one medium 25.
    ``ladder``: the best tier found, 100, 75 or 50.  ``plain``: 50 for any.  ``together`` are worth 100 if a document has all of them.
    """

    name: str
    certain: tuple[str, ...] = ()
    high: tuple[str, ...] = ()
    medium: tuple[str, ...] = ()
    style: str = "tiers"
    together: tuple[str, ...] = ()


# Banks in the order that settles ties, and what names them; of identifiers one of which contains another of the same tier, the shorter one.
BANKS = (
    Bank("Revolut", high=("revolut",), style="plain"),
    Bank("N26", ("ntsbdeb1", "n26 bank", "n26 gmbh"), ("n26", "number26"), ("kontoauszug nr.", "verbuchungsdatum", "wertstellung", "gutschriften", "belastungen")),
    Bank("bunq", ("bunqnl82", "bunq b.v.", "www.bunq.com"), ("bunq", "naritaweg 131-133", "1043bs amsterdam"), ("zinsdatum", "gegenpartei")),
    Bank("DKB", ("deutsche kreditbank ag", "byladem1", "bylademmxxx", "12030000"), ("deutsche kreditbank", "dkb ag", "dkb-ag", "dkb.de", "wir haben für sie gebucht"), ("dkb", "belastung in eur", "gutschrift in eur")),
    Bank("ING DiBa", ("ingddeff", "ing-diba ag", "de29 5001 0517", "de50 5001 0517"), ("ing-diba", "ing diba", "ing.de", "ing deutschland", "girokonto-auszug"), ("extra-konto", "ing ag"), "ladder"),
    Bank("Sparkasse", ("sparkasse", "nasspa", "naspa", "haspa", "ospa", "nospa", "s-girostart"), ("spk ", "helaba"), ("kontoauszug",)),
    Bank("Deutsche Bank", ("deutdedb", "deutdeff", "deutsche bank ag"), ("deutsche bank", "deutsche-bank.de")),
    Bank("Postbank", ("pbnkdeff", "postbank ag"), ("postbank", "postbank.de", "eine niederlassung der deutsche bank"), ("buchung/wert", "vorgang/buchungsinformation", "alter kontostand")),
    Bank("Commerzbank", ("cobadeff", "cobadehd", "commerzbank ag"), ("commerzbank", "dresdner bank", "commerzbank.de"), ("zu ihren lasten", "zu ihren gunsten", "buchungsdatum:", "alter kontostand vom", "buchungstag", "umsatzart")),
    Bank("Volksbank/VR-Bank", ("genode", "vr-bank", "vr bank", "vrbank", "vr-networld", "vr networld"), ("volksbank", "raiffeisenbank", "genossenschaftsbank", "volks- und raiffeisenbank", "raiffeisen-volksbank", "vereinigte volksbank"), ("bu-tag", "kartenzahlung girocard", "basislastschrift pn:", "pn:931")),
    Bank("C24 Bank", ("c24 bank", "c24bank", "c24-bank"), ("check24", "c24 smart", "c24 plus"), ("transaktionsübersicht", "transaktionsinformation")),
    Bank("Consorsbank", ("csdbde71", "consorsbank"), ("consors", "bnp paribas", "cortal consors"), ("text/verwendungszweck", "pnnr", "visa 26466")),
    Bank("TARGOBANK", ("cmcidedd", "targobank"), ("targo bank", "targo-bank", "citibank"), ("monatsübersicht", "finanzstatus", "plus-konto", "guthaben/kredit", "ausgaben", "einnahmen")),
    Bank("1822direkt", ("1822direkt", "1822 direkt", "heladef1822", "50050201"), ("frankfurter sparkasse", "1822direct", "heaborh"), ("sepa-basislastschrift", "sepa eingang", "gaa,spk.netz", "buchung", "wertstellung", "kto. auftraggeber")),
    Bank("Tomorrow", ("sobkdeb2", "sobkdebbxxx", "tomorrow gmbh", "tomorrow bank"), ("tomorrow",), ("rechnungsabschluss", "buchung / valuta", "hauptkonto")),
    Bank("apoBank", ("apobank", "apo bank", "apo-bank", "daaededd", "bank der gesundheit", "deutsche apotheker- und ärztebank"), ("apotheker", "ärztebank", "deutsche apotheker", "300 606 01", "30060601"), ("wertstellung:", "kartenzahlung debitkarte", "buchungsdatum", "beschreibung", "übertrag", "saldo in eur", "kunden-nr", "konto-nr", "referenz-nr")),
    Bank("Sparda-Bank", ("spardagiro", "sparda-bank", "sparda bank"), ("genodef1s", "genodef1p", "genodef1m", "genoded1spk", "sparda"), ("buchungstag", "buchungstext", "wertstellung", "betrag in eur", "kontoauszug nr", "sepa-überweisung", "sepa-basislastschrift", "sepa-lohn/gehalt")),
    Bank("Norisbank", ("norisbank", "norsde51", "nors de 51"), ("noris bank", "noris-bank", "deutsche bank gruppe", "(030) 310 66 005", "10910 berlin"), ("kontoauszug vom", "kontoinhaber:", "alter saldo per", "neuer saldo", "verwendungszweck/ kundenreferenz", "verwendungszweck/kundenreferenz", "bargeldauszahlung gaa", "buchung", "valuta", "vorgang", "soll", "haben"), together=("noris", "bank")),
    Bank("Oldenburgische Landesbank", ("oldenburgische landesbank", "olbodeh2", "olb ag"), ("landesbank ag", "49809 lingen", "0591 80013"), ("euro-konto", "alter saldo", "neuer saldo", "buchung", "wert", "geldautomat", "ueberwsg", "lfd.lastsch", "gutschrift")),
)
#: Scores from which a bank is chosen, and below which the second best has to be.
CHOSEN, SECOND = 75, 50


def bank_scores(lines: DataFrame, banks: Sequence[Bank] = BANKS) -> DataFrame:
    """``file``, ``bank``, ``place`` (in the list) and ``score`` of each bank that lines (``file``, ``text``) name at all.

    Identifiers are found in any case, within one line, wherever in the document it stands.
    """
    rows = [(b.name, i, b.style, tier, x, len(b.together)) for i, b in enumerate(banks) for tier in ("certain", "high", "medium", "together") for x in getattr(b, tier)]
    known = lines.sparkSession.createDataFrame(rows, "bank string, place int, style string, tier string, identifier string, together int")
    every = sorted({r[4] for r in rows})
    low = lines.select("file", F.lower("text").alias("low")).where(F.col("low").rlike(pattern_of(every)))
    hits = low.select("file", F.explode(F.filter(F.array(*map(F.lit, every)), lambda x: F.contains(F.col("low"), x))).alias("identifier")).distinct()
    n = lambda tier: F.count(F.when(F.col("tier") == tier, 1))
    counted = hits.join(F.broadcast(known), "identifier").groupBy("file", "bank", "place", "style").agg(n("certain").alias("c"), n("high").alias("h"), n("medium").alias("m"), (n("together") == F.max("together")).alias("t"), F.max("together").alias("of"))
    certain = (F.col("c") > 0) | ((F.col("of") > 0) & F.col("t"))
    tiers = F.when(certain, 100).when((F.col("h") > 1) | ((F.col("h") == 1) & (F.col("m") > 0)), 75).when((F.col("h") == 1) | (F.col("m") > 1), 50).when(F.col("m") == 1, 25).otherwise(0)
    ladder = F.when(certain, 100).when(F.col("h") > 0, 75).otherwise(50)
    score = F.when(F.col("style") == "tiers", tiers).when(F.col("style") == "ladder", ladder).otherwise(50)
    return counted.select("file", "bank", "place", score.alias("score")).where("score > 0")


def choose_bank(lines: DataFrame, banks: Sequence[Bank] = BANKS) -> DataFrame:
    """``file``, ``bank``, ``best``, ``score``, ``second_score`` of every document: ``bank`` is the best one if it has 75 and the second has not 50, else null, which asks for a choice by hand.

    Of equal scores the bank that stands earlier is better.  A document that names no bank has only nulls.
    """
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("by"), "place", "bank")))  # as many as there are banks at most
    best = bank_scores(lines, banks).groupBy("file").agg(ranked.alias("ranked"))
    first, second = F.get("ranked", 0), F.get("ranked", 1)
    clear = (-first["by"] >= CHOSEN) & (F.coalesce(-second["by"], F.lit(0)) < SECOND)
    told = best.select("file", F.when(clear, first["bank"]).alias("bank"), first["bank"].alias("best"), (-first["by"]).alias("score"), (-second["by"]).alias("second_score"))
    return lines.select("file").distinct().join(told, "file", "left")


_HEADS = [
    ["Deutsche Bank AG", "BIC: DEUTDEFF"], ["SPARKASSE Musterstadt", "Kontoauszug"], ["Ihre Postbank", "Buchung/Wert"], ["Ihre Volksbank", "ohne weiteres"], ["Commerzbank AG, früher Dresdner Bank", "dkb.de und DKB AG"],
    ["Noris", "Ihre Bank in der Nähe"], ["ING Deutschland", "Extra-Konto"], ["Revolut Ltd"], ["kein Name"], ["N26", "Wertstellung"], ["www.bunq.com", "zinsdatum"],
]


@query("""SELECT file, found[1] AS bank, found[2] AS best, CAST(found[3] AS INTEGER) AS score, CAST(found[4] AS INTEGER) AS second_score FROM (
  SELECT 's' || id AS file, [['Deutsche Bank', 'Deutsche Bank', '100', NULL], ['Sparkasse', 'Sparkasse', '100', NULL], [NULL, 'Postbank', '75', '50'], [NULL, 'Volksbank/VR-Bank', '50', NULL], [NULL, 'Commerzbank', '100', '75'],
  ['Norisbank', 'Norisbank', '100', NULL], ['ING DiBa', 'ING DiBa', '75', NULL], [NULL, 'Revolut', '50', NULL], [NULL, NULL, NULL, NULL], ['N26', 'N26', '75', '25'], ['bunq', 'bunq', '100', NULL]][1 + id % 11] AS found FROM statements)""")
def bank_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank of every statement, from heads that name one clearly, two, or none."""
    heads = F.array(*(F.array(*map(F.lit, h)) for h in _HEADS))
    head = F.get(heads, (F.col("id") % len(_HEADS)).cast("int"))
    lines = views.statements(spark, sf_dir).select(F.concat(F.lit("s"), "id").alias("file"), F.explode(head).alias("text"))
    return choose_bank(lines)
