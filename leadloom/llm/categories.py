"""Problem 6: typed business categories mapped to the canonical list, or to 0 where none fits.

Method: token-level repair, then soft TF-IDF. Every distinct token of the typed values is joined to the
reference vocabulary within one edit (deletion neighbourhood) or as an abbreviation; the repaired tokens rank
the complete entries by soft TF-IDF, and the best entry counts if it is similar enough. The reference
vocabulary holds the canonical names, common trade names in several languages, and entries learned from the
listings themselves: a value no entry explains, but which nearly always comes from searches for one category,
is another name of it; a value that comes from searches for everything means nothing in particular.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.session import cut, small

from .addresses import deletions, folded, one_edit

# Other names of the trades, in English, French, German and Spanish.
OTHER_NAMES = {
    "Dental Clinic": "dentist; orthodontist practice; tooth doctor; cabinet dentaire; zahnarztpraxis; clínica dental",
    "Physiotherapist": "physio centre; physical therapy; fisioterapeuta; kinésithérapeute",
    "Pharmacy": "drugstore; chemist; medical store; apotheke; pharmacie; farmacia",
    "Optician": "spectacle store; eyewear shop; óptica; augenoptiker",
    "General Practitioner": "gp surgery; family doctor; médico de cabecera; hausarzt",
    "Veterinarian": "vet clinic; animal hospital; tierarzt; veterinario",
    "Restaurant": "bistro; dining room; brasserie; restaurante; gaststätte",
    "Coffee Shop": "café; coffeehouse; espresso bar; kaffeehaus; cafetería",
    "Bakery": "patisserie; bread shop; boulangerie; panadería",
    "Butcher": "meat shop; boucherie; metzgerei",
    "Ice Cream Parlour": "gelateria; gelato bar; eisdiele; heladería",
    "Grocery Store": "supermarket; provision store; lebensmittelladen; épicerie",
    "Catering Service": "caterer; banquet food supplier; traiteur; servicio de banquetes",
    "Hair Salon": "hairdresser; unisex haircutting; peluquería; friseur; coiffeur",
    "Barber": "gents shaving parlour; men's haircuts; barbería",
    "Nail Studio": "manicure bar; pedicure lounge; nagelstudio; salón de uñas",
    "Day Spa": "wellness retreat; massage centre",
    "Tattoo Parlour": "body art shop; ink studio; estudio de tatuajes",
    "Plumber": "pipe repair; drain unblocking; plombier; klempner; fontanero",
    "Electrician": "electrical repairs; wiring contractor; elektriker; electricista",
    "Roofing Contractor": "roof repair; roofer; dachdecker",
    "Carpenter": "joinery; woodworking workshop; tischlerei; menuisier",
    "Locksmith": "key cutting; lockout help; schlüsseldienst; serrurier; cerrajero",
    "Pest Control": "exterminator; termite treatment; control de plagas; schädlingsbekämpfung",
    "House Painter": "home decorating; wall painting contractor; pintor de casas",
    "Car Repair": "mechanic; auto garage; vehicle servicing; autowerkstatt",
    "Car Wash": "vehicle valeting; auto detailing; waschstraße",
    "Vehicle Rental": "rent a car; car hire; autovermietung; alquiler de coches",
    "Tyre Dealer": "tire shop; wheel alignment; reifenhandel; neumáticos",
    "Driving School": "driver lessons; motor training academy; fahrschule; autoescuela",
    "Language School": "spoken english classes; foreign language institute; sprachschule",
    "Music Teacher": "guitar tuition; piano lessons; profesor de música",
    "Kindergarten": "play school; nursery school; preschool; école maternelle",
    "Fitness Centre": "gym; health club; fitnessstudio",
    "Yoga Studio": "asana classes; meditation and yoga; centro de yoga",
    "Guest House": "bed and breakfast; homestay; inn; pension",
    "Travel Agency": "tour operator; holiday planner; agencia de viajes",
    "Law Firm": "solicitor; attorney; advocates; cabinet d'avocats; rechtsanwalt; abogados",
    "Accountant": "bookkeeping; chartered accounts; tax adviser; contable; steuerberater",
    "Estate Agent": "realtor; property broker; immobilienmakler; inmobiliaria",
    "Insurance Broker": "insurance agency; cover adviser; corredor de seguros",
    "Florist": "bouquet delivery; flower shop; floristería; blumenladen",
    "Bookshop": "bookseller; book store; buchhandlung; librería",
    "Jeweller": "gold shop; jewelry store; juwelier; joyería",
    "Furniture Store": "home furnishings; sofa showroom; möbelhaus; mueblería",
    "Mobile Phone Shop": "cell phone store; smartphone repair; handyladen; tienda de móviles",
    "Pet Supplies": "pet food store; aquarium and pet shop; tienda de mascotas",
    "Laundry Service": "dry cleaner; laundromat; lavandería; blanchisserie",
}
# Words that say nothing about the trade.
FILLERS = ("best", "top", "cheap", "near", "me", "services", "more", "open", "now", "category", "in", "the", "and", "of", "a", "de", "s")
SIMILAR = 0.75
# A value is another name of the category that LEARN_SHARE of its searches are for, and means nothing in particular
# where no category has NOISE_SHARE of them; both must be sure to Z standard errors, however many rows there are.
LEARN_SHARE, NOISE_SHARE, Z = 0.9, 0.5, 1.64


def share_bound(k: Column, n: Column, side: int) -> Column:
    """Lower (-1) or upper (1) bound of the share k of n, by Wilson's score interval."""
    p = k / n
    return (p + Z * Z / (2 * n) + side * Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def value_tokens(c: Column) -> Column:
    """Words of a typed value: decoration and place taken off, digits that stand for letters put back.

    A full stop at the end of a word stays, since it marks an abbreviation.
    """
    s = F.regexp_replace(c, r"(?<=\p{Ll})(?=\p{Lu}\p{Ll})", " ")
    s = F.regexp_replace(folded(s), r"\([^)]*\)|^\s*category:|^\s*[0-9][.,][0-9]\s*[·•|-]", " ")
    s = F.regexp_replace(s, r"\s[·•|]\s.*$|\s-\s[^-]*$|\sin\s\S.*$", " ")
    s = F.regexp_replace(s, r"^\s*(top\s+\d+|best|cheap)\s|\s(near me|& more|open now)\s*$", " ")
    words = F.split(F.regexp_replace(s, r"[^a-z0-9.]+", " "), r"\s+")
    words = F.transform(words, lambda w: F.regexp_replace(w, r"^\.+|(?<=\.)\.+$", ""))
    words = F.transform(words, lambda w: F.when(w.rlike("[a-z]") & w.rlike("[0-9]"), F.translate(w, "01345789", "oieastbg")).otherwise(w))
    return F.filter(words, lambda w: (w != "") & (w != "."))


def _entries(spark: SparkSession, ref: DataFrame, other_names: dict[str, str]) -> DataFrame:
    """(category_id, phrase): canonical names and their other names, for the categories that ref has."""
    rows = [(k, p.strip()) for k, v in other_names.items() for p in v.split(";")]
    other = spark.createDataFrame(rows, "category_name string, phrase string")  # a parameter
    names = ref.select("category_id", "category_name")
    return names.select("category_id", F.col("category_name").alias("phrase")).unionByName(
        names.join(F.broadcast(other), "category_name").select("category_id", "phrase")
    )


def _glued(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda w: F.replace(w, F.lit("."), F.lit(""))), "")


def rank_entries(phrases: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, category_id, sim): the best entry of every phrase that shares a repaired token with one.

    phrases: (key, tokens). entries: (category_id, tokens). Each phrase and entry is also seen as one word
    without blanks, so that joined and split spellings meet. Ties go to the smaller category_id.
    """
    e = entries.filter(F.size("tokens") > 0).withColumn("tokens", F.transform("tokens", lambda w: F.replace(w, F.lit("."), F.lit("")))).distinct()
    e = e.select("category_id", F.array_distinct("tokens").alias("own"), _glued(F.col("tokens")).alias("glued"))
    forms = e.select("category_id", F.col("own").alias("form")).unionByName(
        e.filter(F.size("own") > 1).select("category_id", F.array("glued").alias("form"))
    ).withColumn("entry", F.xxhash64("category_id", "form"))
    forms = cut(forms)
    total = F.lit(float(max(1, forms.count())))
    df = forms.select("entry", F.explode("form").alias("v")).distinct()
    idf = df.groupBy("v").agg(F.log(1 + total / F.count("*")).alias("idf"))
    index = cut(df.join(idf, "v").join(forms.select("entry", "category_id").distinct(), "entry"))
    norms = index.groupBy("entry").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    top_idf = F.log(1 + total)
    vocab = index.select("v", "idf").distinct()

    p = phrases.select("key", F.array_distinct("tokens").alias("own"), _glued(F.col("tokens")).alias("glued"))
    seen = cut(
        p.select("key", F.lit(0).alias("view"), F.explode("own").alias("t"))
        .unionByName(p.filter((F.size("own") > 1) & (F.length("glued") > 5)).select("key", F.lit(1).alias("view"), F.col("glued").alias("t")))
    )
    toks = seen.select("t").distinct().withColumn("stem", F.regexp_replace("t", r"\.+$", ""))
    tv = toks.select("t", "stem", F.explode(F.when(F.length("stem") > 3, deletions(F.col("stem"))).otherwise(F.array("stem"))).alias("x"))
    vv = vocab.select("v", "idf", F.explode(F.when(F.length("v") > 3, deletions(F.col("v"))).otherwise(F.array("v"))).alias("x"))
    edits = tv.join(vv, "x").filter((F.col("stem") == F.col("v")) | (F.col("stem") == F.concat("v", F.lit("s"))) | ((F.least(F.length("stem"), F.length("v")) >= 4) & one_edit(F.col("stem"), F.col("v")))).select(
        "t", "v", "idf", F.when(F.col("stem") == F.col("v"), 1.0).otherwise(0.92).alias("sim")
    )
    prefixes = vocab.filter(F.length("v") > 3).select("v", "idf", F.explode(F.transform(F.sequence(F.lit(3), F.length("v") - 1), lambda n: F.substring(F.col("v"), F.lit(1), n))).alias("stem"))
    short = toks.filter(F.col("t").endswith(".")).join(prefixes, "stem").select("t", "v", "idf", F.lit(0.94).alias("sim"))
    repair = cut(edits.unionByName(short).groupBy("t", "v").agg(F.max("idf").alias("idf"), F.max("sim").alias("sim")))
    # a token weighs as its best repair; one that the vocabulary doesn't know weighs most, a filler nothing
    best = repair.groupBy("t").agg(F.max(F.struct("sim", "idf")).alias("b")).select("t", "b.sim", F.col("b.idf").alias("w"))
    filler = F.col("t").isin(*FILLERS) & (F.coalesce("sim", F.lit(0.0)) < 1.0)
    weights = seen.join(best, "t", "left").withColumn("w", F.when(filler, 0.0).otherwise(F.coalesce("w", top_idf)))
    size = weights.groupBy("key", "view").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    hits = (
        seen.join(repair.select("t", "v", "sim"), "t").join(index, "v")
        .groupBy("key", "view", "entry", "category_id", "v").agg(F.max("sim").alias("sim"), F.max("idf").alias("idf"))
        .groupBy("key", "view", "entry", "category_id").agg(F.sum(F.col("sim") * F.col("idf") * F.col("idf")).alias("dot"))
    )
    ranked = hits.join(size, ["key", "view"]).join(norms, "entry").filter("size > 0").select(
        "key", "category_id", F.least(F.lit(1.0), F.round(F.col("dot") / (F.col("size") * F.col("norm")), 9)).alias("sim")
    )
    return ranked.groupBy("key").agg(F.min(F.struct((-F.col("sim")).alias("m"), "category_id")).alias("b")).select("key", "b.category_id", (-F.col("b.m")).alias("sim"))


def map_categories(listings: DataFrame, leads: DataFrame, ref: DataFrame, similar: float = SIMILAR, other_names: dict[str, str] | None = None) -> DataFrame:
    """(table_name, record_no, category_id) for every record with a value; 0 where no entry fits.

    Null and blank values give no row, values without any letter or digit give 0, repeated rows one row.
    Work is done once per distinct value, however many rows hold it. other_names: names of the reference list's entries
    separated by semicolons; by default OTHER_NAMES, {} for none, so that only the listings teach further names.
    """
    spark = ref.sparkSession
    search = F.lower(F.regexp_extract("query_text", r"^(.*?) in ", 1))
    rows = listings.select(F.lit("maps_listing").alias("table_name"), "record_no", F.col("category_hint").alias("value"), search.alias("search")).unionByName(
        leads.select(F.lit("lead_row").alias("table_name"), "record_no", F.col("category").alias("value"), F.lit(None).cast("string").alias("search"))
    )
    rows = rows.filter(F.col("value").rlike(r"[^\s\p{Z}]")).distinct().withColumn("tokens", value_tokens(F.col("value")))
    rows = cut(rows.select("table_name", "record_no", "search", "tokens", F.array_join("tokens", " ").alias("key")))
    phrases = cut(rows.filter("key <> ''").select("key", "tokens").distinct())
    base = _entries(spark, ref, OTHER_NAMES if other_names is None else other_names).select("category_id", value_tokens(F.col("phrase")).alias("tokens"))
    first = cut(rank_entries(phrases, base))

    searched = small(ref.select(F.lower("category_name").alias("search"), F.col("category_id").alias("for_id")))
    usage = rows.filter("key <> ''").join(searched, "search").groupBy("key", "for_id").agg(F.count("*").alias("n"))
    usage = usage.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "for_id")).alias("top"))
    usage = usage.select("key", "n", F.col("top.for_id").alias("for_id"), F.col("top.n").alias("k"))
    known = usage.join(first, "key", "left")
    settled = F.coalesce(F.col("sim"), F.lit(0.0)) >= similar
    names = (F.col("k") / F.col("n") >= LEARN_SHARE) & (share_bound(F.col("k"), F.col("n"), -1) >= 0.5) & ~(settled & (F.col("category_id") == F.col("for_id")))
    noise = (share_bound(F.col("k"), F.col("n"), 1) <= NOISE_SHARE) & (F.coalesce(F.col("sim"), F.lit(0.0)) < 1.0)
    learned = known.filter(names | noise).select(F.when(names, F.col("for_id")).otherwise(0).alias("category_id"), "key").join(phrases, "key").select("category_id", "tokens")
    open_ = phrases.join(first.filter("sim = 1.0"), "key", "left_anti")
    second = rank_entries(open_, cut(learned))
    best = first.select("key", "category_id", "sim", F.lit(1).alias("pass")).unionByName(second.select("key", "category_id", "sim", F.lit(0).alias("pass")))
    found = (
        best.filter(F.col("sim") >= similar).groupBy("key")
        .agg(F.max(F.struct("sim", (-F.col("pass")).alias("p"), "category_id"))["category_id"].alias("category_id"))
    )
    found = small(cut(found), 100_000)
    return rows.select("table_name", "record_no", "key").join(found, "key", "left").select(
        "table_name", "record_no", F.coalesce("category_id", F.lit(0)).cast("int").alias("category_id")
    )
