"""Word tables of record normalization. Keys are folded: lower case, no accents, no dots."""

from __future__ import annotations

import re
import unicodedata

# Right results depend on exactly these words.

LEGAL_FORMS = {
    "llc": "llc", "inc": "inc", "incorporated": "inc", "lnc": "inc", "corp": "corp", "corporation": "corp",
    "co": "co", "company": "co", "ltd": "ltd", "limited": "ltd", "lp": "lp", "llp": "llp", "pllc": "pllc",
    "plc": "plc", "pc": "pc", "pa": "pa",
    "pvt": "pvt", "private": "pvt", "opc": "opc",
    "sarl": "sarl", "sas": "sas", "sasu": "sasu", "sa": "sa", "sci": "sci", "eurl": "eurl", "snc": "snc",
    "scop": "scop", "selarl": "selarl", "scm": "scm", "gie": "gie", "ets": "ets", "etablissements": "ets",
    "gmbh": "gmbh", "ag": "ag", "bv": "bv", "nv": "nv", "pty": "pty", "srl": "srl", "spa": "spa", "sl": "sl",
    "ab": "ab", "oy": "oy",
}
HONORIFICS = ("the", "shri", "sri", "shree", "smt", "dr", "mr", "mrs", "ms", "messrs", "m s")
DOMAIN_HONORIFICS = ("the", "shri", "sri", "smt", "dr", "mr", "mrs", "ms")
ALIAS_MARKERS = (
    "formerly known as", "doing business as", "also known as", "known as", "trading as",
    "t/a", "d/b/a", "a/k/a", "f/k/a", "dba", "aka", "fka", "formerly",
)
COUNTRY_WORDS = ("india", "france", "usa", "us", "america")
LEET = (("0", "o"), ("1", "l"), ("3", "e"), ("4", "a"), ("5", "s"), ("7", "t"))
TLDS = ("co.in", "com", "net", "org", "in", "co", "fr", "biz", "info", "io", "us")
STREET_TYPES = {
    "street": "st", "str": "st", "saint": "st", "road": "rd", "avenue": "ave", "av": "ave", "boulevard": "blvd",
    "bd": "blvd", "drive": "dr", "lane": "ln", "court": "ct", "circle": "cir", "place": "pl", "trail": "trl",
    "highway": "hwy", "parkway": "pkwy", "terrace": "ter", "square": "sq", "north": "n", "south": "s",
    "east": "e", "west": "w", "apartment": "apt", "building": "bldg", "floor": "fl", "first": "1st",
    "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th", "sainte": "ste", "mount": "mt",
    "allee": "allee", "all": "allee", "route": "rte", "chemin": "chem", "chm": "chem", "ch": "chem",
    "impasse": "imp", "cours": "crs", "residence": "res", "etage": "fl",
}
CITY_ALIASES = {
    "bombay": "mumbai", "poona": "pune", "bangalore": "bengaluru", "calcutta": "kolkata", "madras": "chennai",
    "gurgaon": "gurugram", "trivandrum": "thiruvananthapuram", "vishakhapatnam": "visakhapatnam",
    "ahmadabad": "ahmedabad", "orissa": "odisha", "keralam": "kerala", "baroda": "vadodara", "mysore": "mysuru",
    "cochin": "kochi",
}
ADDRESS_LABELS = (
    "no", "n", "number", "num", "door", "house", "h", "hno", "hn", "flat", "plot", "shop", "office", "off",
    "room", "unit", "suite", "pmb", "po", "box", "bis", "ter", "null", "none", "na", "nil",
)
FRENCH_STREET_TYPES = {"r": "rue"}
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "district of columbia": "dc", "florida": "fl", "georgia": "ga",
    "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks",
    "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma",
    "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt",
    "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm",
    "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok",
    "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd",
    "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
    "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy", "puerto rico": "pr",
}
INDIAN_STATES = {
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg",
    "goa": "ga", "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh",
    "karnataka": "ka", "kerala": "kl", "keralam": "kl", "madhya pradesh": "mp", "maharashtra": "mh",
    "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od",
    "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "telangana": "tg", "tripura": "tr",
    "uttar pradesh": "up", "uttarakhand": "uk", "uttaranchal": "uk", "west bengal": "wb", "delhi": "dl",
    "jammu and kashmir": "jk", "jammu kashmir": "jk", "ladakh": "la", "chandigarh": "ch", "puducherry": "py",
    "pondicherry": "py", "andaman and nicobar islands": "an", "lakshadweep": "ld",
    "dadra and nagar haveli and daman and diu": "dn",
    "महाराष्ट्र": "mh", "दिल्ली": "dl", "उत्तर प्रदेश": "up", "ಕರ್ನಾಟಕ": "ka", "தமிழ்நாடு": "tn", "ગુજરાત": "gj",
    "পশ্চিমবঙ্গ": "wb", "తెలంగాణ": "tg", "हरियाणा": "hr", "राजस्थान": "rj", "കേരളം": "kl", "बिहार": "br",
    "मध्य प्रदेश": "mp", "ఆంధ్రప్రదేశ్": "ap", "ਪੰਜਾਬ": "pb", "ଓଡ଼ିଶା": "od",
}
OLDER_INDIAN_CODES = {"or": "od", "ts": "tg", "ct": "cg", "ut": "uk"}
FRENCH_REGIONS = {
    "auvergne rhone alpes": "ara", "bourgogne franche comte": "bfc", "bretagne": "bre",
    "centre val de loire": "cvl", "corse": "cor", "grand est": "ges", "hauts de france": "hdf",
    "ile de france": "idf", "normandie": "nor", "nouvelle aquitaine": "naq", "occitanie": "occ",
    "pays de la loire": "pdl", "provence alpes cote d azur": "pac", "provence alpes cote dazur": "pac",
}
FRENCH_DEPARTMENTS = {
    "ara": "ain, allier, ardeche, cantal, drome, isere, loire, haute loire, puy de dome, rhone, savoie, haute savoie",
    "bfc": "cote d or, doubs, jura, nievre, haute saone, saone et loire, yonne, territoire de belfort",
    "bre": "cotes d armor, finistere, ille et vilaine, morbihan",
    "cvl": "cher, eure et loir, indre, indre et loire, loir et cher, loiret",
    "cor": "corse du sud, haute corse",
    "ges": "ardennes, aube, marne, haute marne, meurthe et moselle, meuse, moselle, bas rhin, haut rhin, vosges",
    "hdf": "aisne, nord, oise, pas de calais, somme",
    "idf": "paris, seine et marne, yvelines, essonne, hauts de seine, seine saint denis, val de marne, val d oise",
    "nor": "calvados, eure, manche, orne, seine maritime",
    "naq": "charente, charente maritime, correze, creuse, dordogne, gironde, landes, lot et garonne, pyrenees atlantiques, deux sevres, vienne, haute vienne",
    "occ": "ariege, aude, aveyron, gard, haute garonne, gers, herault, lot, lozere, hautes pyrenees, pyrenees orientales, tarn, tarn et garonne",
    "pdl": "loire atlantique, maine et loire, mayenne, sarthe, vendee",
    "pac": "alpes de haute provence, hautes alpes, alpes maritimes, bouches du rhone, var, vaucluse",
}
# End of the fixed values.


def fold(text: str) -> str:
    """Compatibility form without non-spacing marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")


def state_tables() -> dict[str, dict[str, str]]:
    """By lower-case country: every folded state name or code, with its code."""

    def keys(table: dict[str, str]) -> dict[str, str]:
        # Names go through the same cleaning as address components, so that they meet.
        return {re.sub(r"[^\wऀ-෿]+", " ", fold(k.lower())).strip(): v for k, v in table.items()}

    french = FRENCH_REGIONS | {d: region for region, names in FRENCH_DEPARTMENTS.items() for d in names.split(", ")}
    return {
        "us": keys(US_STATES | {c: c for c in US_STATES.values()}),
        "india": keys(INDIAN_STATES | {c: c for c in INDIAN_STATES.values()} | OLDER_INDIAN_CODES),
        "france": keys(french),
    }


def street_tables() -> dict[str, dict[str, str]]:
    """By lower-case country ("" for all others): a word's canonical form, empty to drop it. Labels win over street types."""
    common = STREET_TYPES | CITY_ALIASES | dict.fromkeys(ADDRESS_LABELS, "")
    return {"": common, "france": common | FRENCH_STREET_TYPES}
