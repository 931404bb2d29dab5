"""The unit catalog: units with their names, symbols and prefixes, and the table of every form of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.functions.lexicon import PREFIXES
from metrolith.functions.spans import constant_lookup

SI = ("n", "μ", "µ", "m", "c", "d", "k", "M", "G", "T")
BINARY = ("k", "M", "G", "T", "P", "E", "Ki", "Mi", "Gi", "Ti", "Pi")


@dataclass(frozen=True)
class Unit:
    key: str
    entity: str
    surfaces: tuple[str, ...] = ()
    symbols: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    currency_code: str | None = None


def _unit(entity: str, line: str, prefixes: tuple[str, ...] = ()) -> Unit:
    """'key; surface, surface; symbol, symbol' with plain plurals added."""
    key, surfaces, symbols = (x.strip() for x in (line + ";;").split(";")[:3])
    names = [s.strip() for s in surfaces.split(",") if s.strip()] or []
    names = [key, *names] if key not in names else names
    names += [_plural(n) for n in list(names)]
    return Unit(key, entity, tuple(dict.fromkeys(names)), tuple(s.strip() for s in symbols.split(" ") if s.strip()), prefixes)


def _plural(name: str) -> str:
    if name.endswith(("s", "z", "²")):
        return name
    if name.endswith(("ch", "sh", "x")):
        return name + "es"
    if name.endswith("y") and name[-2:-1] not in "aeiou":
        return name[:-1] + "ies"
    return name + "s"


_LINES: list[tuple[str, tuple[str, ...], str]] = [
    ("ratio", (), "percentage; percent, per cent, pct; % pct pct. pc"),
    ("ratio", (), "percentage point; percentage point, percent point; pp"),
    ("ratio", (), "basis point; basis point; bp bps"),
    ("ratio", (), "permille; per mille; ‰"),
    ("length", SI, "metre; meter, metre; m"),
    ("length", (), "inch; inch, in.; ″"),
    ("length", (), "foot; foot, feet, ft.; ft ′"),
    ("length", (), "yard; yard; yd"),
    ("length", (), "mile; mile; mi"),
    ("length", (), "nautical mile; nautical mile; nmi"),
    ("length", (), "light-year; light-year, light year; ly"),
    ("length", (), "angstrom; angstrom; Å"),
    ("length", (), "astronomical unit; astronomical unit; au"),
    ("mass", ("n", "μ", "µ", "m", "c", "k", "M"), "gram; gram, gramme; g"),
    ("mass", (), "tonne; tonne, metric ton; t"),
    ("mass", (), "ton; ton"),
    ("mass", (), "pound-mass; lb; lb lbs"),
    ("mass", (), "ounce; ounce; oz"),
    ("mass", (), "stone; stone; st"),
    ("mass", (), "carat; carat; ct"),
    ("time", ("n", "μ", "µ", "m"), "second; second, sec; s"),
    ("time", (), "minute; minute, min; min"),
    ("time", (), "hour; hour, hr; h hr hrs"),
    ("time", (), "day; day; d"),
    ("time", (), "week; week; wk"),
    ("time", (), "fortnight; fortnight"),
    ("time", (), "month; month; mo"),
    ("time", (), "quarter; quarter"),
    ("time", (), "year; year, yr; yr yrs"),
    ("time", (), "decade; decade"),
    ("time", (), "century; century"),
    ("temperature", (), "celsius; celsius, degree celsius, degrees celsius, centigrade; °C degC degc"),
    ("temperature", (), "fahrenheit; fahrenheit, degree fahrenheit, degrees fahrenheit; °F degF degf"),
    ("temperature", (), "kelvin; kelvin; K"),
    ("angle", (), "degree; degree, deg; °"),
    ("angle", ("m",), "radian; radian; rad"),
    ("area", (), "square metre; square meter, square metre, sqm, sq m; m2 m² sqm"),
    ("area", (), "square kilometre; square kilometer, square kilometre; km2 km²"),
    ("area", (), "square foot; square foot, square feet, sq ft; ft2 ft² sqft"),
    ("area", (), "square mile; square mile, sq mi; mi2"),
    ("area", (), "acre; acre; ac"),
    ("area", (), "hectare; hectare; ha"),
    ("volume", ("n", "μ", "µ", "m", "c", "d", "h"), "litre; liter, litre; L l"),
    ("volume", (), "cubic metre; cubic meter, cubic metre; m3 m³"),
    ("volume", (), "cubic foot; cubic foot, cubic feet; ft3 cf"),
    ("volume", (), "gallon; gallon; gal"),
    ("volume", (), "pint; pint; pt"),
    ("volume", (), "quart; quart; qt"),
    ("volume", (), "barrel; barrel; bbl"),
    ("volume", (), "cup; cup"),
    ("volume", (), "tablespoon; tablespoon; tbsp"),
    ("volume", (), "teaspoon; teaspoon; tsp"),
    ("speed", (), "mile per hour; mile per hour; mph"),
    ("speed", (), "kilometre per hour; kilometer per hour, kilometre per hour; kph kmh"),
    ("speed", (), "metre per second; meter per second, metre per second; mps"),
    ("speed", (), "knot; knot; kn"),
    ("energy", SI, "joule; joule; J"),
    ("energy", ("k",), "calorie; calorie; cal"),
    ("energy", ("k", "M", "G", "T"), "watt hour; watt hour, watt-hour; Wh"),
    ("energy", ("k", "M", "G", "T"), "electronvolt; electronvolt; eV"),
    ("energy", (), "british thermal unit; british thermal unit; BTU Btu"),
    ("power", SI, "watt; watt; W"),
    ("power", (), "horsepower; horsepower; hp"),
    ("force", SI, "newton; newton; N"),
    ("pressure", SI, "pascal; pascal; Pa"),
    ("pressure", ("m", "k"), "bar; bar"),
    ("pressure", (), "atmosphere; atmosphere; atm"),
    ("pressure", (), "pound per square inch; pound per square inch; psi"),
    ("frequency", ("m", "k", "M", "G", "T"), "hertz; hertz; Hz HZ"),
    ("frequency", (), "revolution per minute; revolution per minute; rpm"),
    ("electric", SI, "volt; volt; V"),
    ("electric", SI, "ampere; ampere, amp; A"),
    ("electric", SI, "ohm; ohm; Ω Ω"),
    ("electric", SI, "farad; farad; F"),
    ("electric", SI, "coulomb; coulomb; C"),
    ("electric", SI, "henry; henry; H"),
    ("magnetic", SI, "tesla; tesla; T"),
    ("substance", SI, "mole; mole; mol"),
    ("radiation", SI, "becquerel; becquerel; Bq"),
    ("radiation", SI, "sievert; sievert; Sv"),
    ("radiation", SI, "gray; gray; Gy"),
    ("luminous", (), "candela; candela; cd"),
    ("luminous", (), "lumen; lumen; lm"),
    ("luminous", ("m", "k"), "lux; lux; lx"),
    ("level", ("d",), "bel; bel; B"),
    ("data", BINARY, "byte; byte; B"),
    ("data", BINARY, "bit; bit; bit b"),
    ("data", ("k", "M", "G", "T"), "bit per second; bit per second; bps"),
    ("image", ("M", "G"), "pixel; pixel; px pix p"),
    ("image", (), "dots per inch; dots per inch; dpi"),
    ("count", (), "parts per million; parts per million; ppm"),
    ("count", (), "parts per billion; parts per billion; ppb"),
    ("generation", (), "generation wireless; generation wireless; G"),
    ("length", (), "furlong; furlong"),
    ("length", (), "fathom; fathom"),
    ("length", (), "parsec; parsec; pc"),
    ("mass", (), "hundredweight; hundredweight; cwt"),
    ("mass", (), "grain; grain"),
    ("mass", ("k",), "dalton; dalton; Da"),
    ("time", (), "millennium; millennium, millennia"),
    ("angle", (), "arcminute; arcminute, arc minute, minute of arc; arcmin"),
    ("angle", (), "arcsecond; arcsecond, arc second, second of arc; arcsec"),
    ("angle", (), "steradian; steradian; sr"),
    ("area", (), "square centimetre; square centimeter, square centimetre; cm2 cm²"),
    ("area", (), "square millimetre; square millimeter, square millimetre; mm2 mm²"),
    ("area", (), "square inch; square inch, sq in; in2 in²"),
    ("area", (), "square yard; square yard, sq yd; yd2"),
    ("volume", (), "cubic centimetre; cubic centimeter, cubic centimetre; cm3 cm³ cc"),
    ("volume", (), "cubic inch; cubic inch; in3"),
    ("volume", (), "cubic yard; cubic yard; yd3"),
    ("volume", (), "cubic kilometre; cubic kilometer, cubic kilometre; km3 km³"),
    ("volume", (), "fluid ounce; fluid ounce, fl oz"),
    ("volume", (), "bushel; bushel; bu"),
    ("speed", (), "kilometre per second; kilometer per second, kilometre per second; kmps"),
    ("speed", (), "foot per second; foot per second, feet per second; fps"),
    ("acceleration", (), "metre per second squared; meter per second squared, metre per second squared"),
    ("density", (), "gram per cubic centimetre; gram per cubic centimeter, gram per cubic centimetre"),
    ("density", (), "kilogram per cubic metre; kilogram per cubic meter, kilogram per cubic metre"),
    ("energy", (), "therm; therm"),
    ("energy", (), "erg; erg"),
    ("force", (), "dyne; dyne; dyn"),
    ("force", (), "pound-force; pound-force; lbf"),
    ("torque", (), "newton metre; newton meter, newton metre; Nm"),
    ("pressure", (), "torr; torr"),
    ("pressure", (), "millimetre of mercury; millimetre of mercury, millimeter of mercury; mmHg"),
    ("viscosity", ("c",), "poise; poise"),
    ("frequency", (), "beat per minute; beat per minute, beats per minute; bpm"),
    ("frequency", (), "frame per second; frame per second, frames per second"),
    ("electric", SI, "siemens; siemens"),
    ("magnetic", SI, "weber; weber; Wb"),
    ("magnetic", ("k",), "gauss; gauss"),
    ("substance", (), "katal; katal; kat"),
    ("concentration", ("m", "μ", "µ", "n"), "molar; molar"),
    ("radiation", ("m",), "rem; rem"),
    ("radiation", (), "roentgen; roentgen"),
    ("radiation", ("m", "μ", "µ", "n"), "curie; curie; Ci"),
    ("level", (), "neper; neper; Np"),
    ("data", (), "byte per second; byte per second, bytes per second; B/s"),
    ("data", ("k", "M"), "baud; baud; Bd"),
    ("computing", ("k", "M", "G", "T", "P", "E"), "flops; flops; FLOPS"),
    ("image", (), "pixel per inch; pixel per inch, pixels per inch; ppi"),
    ("count", (), "parts per trillion; parts per trillion; ppt"),
    ("count", (), "body mass index; body mass index; BMI"),
]

_MONEY: list[tuple[str, str, str, str]] = [  # key; surfaces; symbols; code
    ("dollar", "dollar, buck", "$", ""),
    ("united states dollar", "us dollar, US dollar, united states dollar, american dollar", "US$ US US$", "USD"),
    ("canadian dollar", "canadian dollar", "C$ CA$", "CAD"),
    ("australian dollar", "australian dollar", "A$ AU$ AUD$", "AUD"),
    ("singapore dollar", "singapore dollar", "S$", "SGD"),
    ("hong kong dollar", "hong kong dollar", "HK$", "HKD"),
    ("euro", "euro", "€", "EUR"),
    ("pound sterling", "pound sterling, pound, quid", "£ GB£", "GBP"),
    ("japanese yen", "japanese yen, yen", "¥ 円 圓", "JPY"),
    ("chinese yuan", "chinese yuan, yuan, renminbi", "RMB", "CNY"),
    ("indian rupee", "indian rupee, rupee", "₹", "INR"),
    ("swiss franc", "swiss franc, franc", "Fr", "CHF"),
    ("malaysian ringgit", "malaysian ringgit, ringgit", "RM", "MYR"),
    ("south korean won", "south korean won, won", "₩", "KRW"),
    ("ghanaian cedi", "ghanaian cedi, cedi", "₵", "GHS"),
    ("vietnamese dong", "vietnamese dong, dong", "₫", "VND"),
    ("georgian lari", "georgian lari, lari", "₾", "GEL"),
    ("costa rican colon", "costa rican colon", "₡", "CRC"),
    ("lao kip", "lao kip, kip", "₭", "LAK"),
    ("mill", "mill", "₥", ""),
    ("bitcoin", "bitcoin", "₿ btc", "BTC"),
    ("cent", "cent", "¢ sen", ""),
    ("penny", "penny, pence, pennies", "", ""),
]

#: Further currencies by ISO 4217 code: code, name of the people, name of the coin if no other word is like it.
_CODES = (
    "AED united arab emirates=dirham, ARS argentine=peso, BDT bangladeshi=taka, BGN bulgarian=, BHD bahraini=dinar, BRL brazilian real=, CLP chilean peso=, COP colombian peso=, CZK czech=koruna, DKK danish krone=, "
    "EGP egyptian pound=, HUF hungarian=forint, IDR indonesian=rupiah, ILS israeli=shekel, ISK icelandic krona=, JOD jordanian dinar=, KES kenyan=shilling, KWD kuwaiti dinar=, KZT kazakhstani=tenge, LKR sri lankan rupee=, "
    "MAD moroccan dirham=, MXN mexican peso=, NGN nigerian=naira, NOK norwegian=krone, NZD new zealand dollar=, PEN peruvian sol=, PHP philippine peso=, PKR pakistani rupee=, PLN polish=zloty, QAR qatari riyal=, "
    "RON romanian leu=, RUB russian=rouble, SAR saudi=riyal, SEK swedish=krona, THB thai=baht, TRY turkish=lira, TWD new taiwan dollar=, UAH ukrainian=hryvnia, ZAR south african rand="
)


def units() -> list[Unit]:
    out = [_unit(entity, line, prefixes) for entity, prefixes, line in _LINES]
    for key, surfaces, symbols, code in _MONEY:
        base = _unit("currency", f"{key};{surfaces};{symbols}")
        symbols_of = tuple(dict.fromkeys([*base.symbols, *([code, code.lower()] if code else [])]))
        out.append(Unit(base.key, "currency", base.surfaces, symbols_of, (), code or None))
    for entry in _CODES.split(", "):
        code, name = entry.split(" ", 1)
        people, coin = name.split("=")
        key = f"{people} {coin}".strip() if coin else people if " " in people else f"{people} lev"
        surfaces = (key, _plural(key), *((coin, _plural(coin)) if coin else ()))
        out.append(Unit(key, "currency", surfaces, (code,), (), code))
    return out


CATALOG: tuple[Unit, ...] = tuple(units())


def forms() -> dict[str, tuple[str, str, str, str]]:
    """Every form to (normalized unit, catalog key, entity, kind). Of several claims the first step wins: key,
    then surfaces and symbols in catalog order, then prefixed symbols, then prefixed names."""
    out: dict[str, tuple[str, str, str, str]] = {}
    for u in CATALOG:
        out.setdefault(u.key, (u.key, u.key, u.entity, "key"))
    for u in CATALOG:
        for s in u.surfaces:
            out.setdefault(s, (u.key, u.key, u.entity, "surface"))
        for s in u.symbols:
            out.setdefault(s, (u.key, u.key, u.entity, "symbol"))
    for u in CATALOG:
        for p in u.prefixes:
            for s in u.symbols:
                out.setdefault(p + s, (PREFIXES[p] + u.key, u.key, u.entity, "prefix"))
    for u in CATALOG:
        if u.prefixes:
            for name in dict.fromkeys(PREFIXES.values()):
                for s in u.surfaces:
                    out.setdefault(name + s, (name + u.key, u.key, u.entity, "prefix"))
    return out


FORMS = forms()

# Forms and units between which the context decides.
AMBIGUOUS: dict[str, tuple[str, str]] = {
    "pound": ("pound sterling", "pound-mass"),
    "pounds": ("pound sterling", "pound-mass"),
    "¥": ("japanese yen", "chinese yuan"),
    "B": ("byte", "bel"),
    "b": ("bit", "barn"),
    "C": ("celsius", "coulomb"),
    "F": ("fahrenheit", "farad"),
    "R": ("south african rand", "roentgen"),
    "P": ("poise", "pixel"),
    "p": ("point", "penny"),
    "a": ("acre", "year"),
    "c": ("cent", "celsius"),
    "kn": ("croatian kuna", "knot"),
    "kt": ("kiloton", "knot"),
    "dram": ("armenian dram", "dram"),
    "'": ("foot", "minute"),
    "′": ("foot", "minute"),
    '"': ("inch", "second"),
    "″": ("inch", "second"),
}

#: Words that speak for a reading of an ambiguous form, by unit.
CUES: dict[str, tuple[str, ...]] = {
    "pound sterling": ("cost", "costs", "price", "pay", "paid", "spent", "worth", "bank", "sold", "bought", "fee", "salary", "tax", "cash", "money"),
    "pound-mass": ("weigh", "weighs", "weighed", "heavy", "lost", "gained", "load", "lift", "lifted", "body", "weight", "baby", "fish"),
    "japanese yen": ("japan", "japanese", "tokyo", "nikkei", "toyota"),
    "chinese yuan": ("china", "chinese", "beijing", "shanghai"),
    "byte": ("file", "memory", "disk", "storage", "download", "data"),
    "bel": ("sound", "noise", "loud", "level"),
    "bit": ("data", "signal", "network", "encryption", "key"),
    "barn": ("nucleus", "scattering", "neutron", "nuclear"),
    "celsius": ("temperature", "warm", "cold", "heat", "oven", "weather", "degrees"),
    "coulomb": ("charge", "electric", "electron", "battery"),
    "fahrenheit": ("temperature", "warm", "cold", "heat", "oven", "weather", "degrees"),
    "farad": ("capacitor", "capacitance", "electric", "circuit"),
    "south african rand": ("africa", "african", "cost", "price", "pay", "bank"),
    "roentgen": ("radiation", "dose", "exposure", "ray"),
    "poise": ("viscosity", "fluid", "liquid"),
    "pixel": ("screen", "image", "display", "video", "camera", "resolution"),
    "point": ("font", "score", "index", "type"),
    "penny": ("cost", "price", "coin", "shares", "pence"),
    "acre": ("land", "farm", "field", "area"),
    "year": ("age", "old", "rate", "annual"),
    "cent": ("cost", "price", "coin", "share", "dividend"),
    "croatian kuna": ("croatia", "croatian", "zagreb", "cost", "price"),
    "knot": ("ship", "wind", "speed", "boat", "sea", "sailing"),
    "kiloton": ("bomb", "yield", "nuclear", "explosion", "tnt"),
    "armenian dram": ("armenia", "armenian", "cost", "price"),
    "dram": ("whisky", "weight", "medicine", "weigh"),
    "foot": ("tall", "height", "high", "long", "wide"),
    "minute": ("latitude", "longitude", "arc", "angle", "degrees"),
    "inch": ("screen", "wide", "long", "tall", "display"),
    "second": ("latitude", "longitude", "arc", "angle", "degrees"),
}


def catalog_frame(spark: SparkSession) -> DataFrame:
    """(key, entity, surfaces, symbols, prefixes, currency_code)."""
    rows = [(u.key, u.entity, list(u.surfaces), list(u.symbols), list(u.prefixes), u.currency_code) for u in CATALOG]
    return spark.createDataFrame(rows, "key string, entity string, surfaces array<string>, symbols array<string>, prefixes array<string>, currency_code string")


def forms_frame(spark: SparkSession) -> DataFrame:
    """(form, norm, unit_key, entity, form_kind): the catalog's bounded look-up table, prefixes crossed in beforehand."""
    rows = [(f, *v) for f, v in FORMS.items()]
    return spark.createDataFrame(rows, "form string, norm string, unit_key string, entity string, form_kind string")


def lookup(form: Column) -> Column:
    """struct(n norm, k key) of a form, null if the catalog does not know it."""
    return constant_lookup({f: {"n": norm, "k": key} for f, (norm, key, _, _) in FORMS.items()}, "struct<n:string,k:string>", form)
