"""Word lists, patterns and thresholds as data: every operator takes them as parameters, with these as defaults.

All values of this module are fixed values: results depend on them, so they are stated as they are, in one place and in order.
Where an operator's result depends on their order (rules, stems, keywords, rivers) they are tuples.
"""

from __future__ import annotations


def _words(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(text.split()))


def _phrases(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(","))


LETTERS = "a-zA-ZåäöÅÄÖ"

# Words that say nothing of a topic, Finnish and Swedish.
STOPWORDS = frozenset(_words("""
on ei se ne ja tai vai mutta vaan että kun jos niin kuin jo myös myöskin vielä vain siis sekä oli olla olen olet
hän he me te minä sinä tämä tuo joka jotka mikä mitä missä milloin koska kuitenkin koko kaikki aina nyt
sen sitä siitä siihen tätä tähän hänen heidän meidän teidän minun sinun
klo mk p n:o y m ko ao em pnä vuonna vuoden vuodesta
och är det att en ett av på för med den de till som om från har hade inte var han hon vi ni sin sig men eller när där här
"""))  # fmt: skip

# Words that mark an article on river ice, Finnish and Swedish.
ICE_TOKENS_FI = frozenset(_words("""
jää jäät jäätyi jäätyminen jäätynyt jäänlähtö jääpato jääpatoja jäänpaksuus tulva tulvat tulvavesi hyytö kiintojää
"""))  # fmt: skip
ICE_TOKENS_SV = frozenset(_words("is isen isläggning islossning ispropp översvämning tjocklek"))
ICE_TOKENS = ICE_TOKENS_FI | ICE_TOKENS_SV

# Patterns of each category of a sentence, in order.
CATEGORIES = {
    "freeze": "jokien jäätyminen, jäätyi, jäässä, jääkansi, joenjää, jokijää, kohvajää, suppojää, ahtojää, hyhmä, hyyde",
    "breakup": "jäänlähtö, jäidenlähtö, jään murtuminen, jokien avautuminen, avautui, jäät lähtivät, lähti jäistä",
    "ice_jam": "jääpato, hyydepato, jää ?tukos, jäälautta, jääpadon purkautuminen, jääpatojen purku",
    "flood": "tulva, kevättulva, talvitulva",
    "ice_conditions": "jäänpaksuus, jäätilanne, jään vahingot",
}
CATEGORY_RULES = tuple((category, pattern) for category, text in CATEGORIES.items() for pattern in _phrases(text))

# Stems of each river's names, in order.
RIVERS = {
    "Tornionjoki": "tornionjok tornionjoe tornion",
    "Kemijoki": "kemijok kemijoe kemin kemijo",
    "Oulujoki": "oulujok oulujoe oulunjo oulujo",
    "Kiiminkijoki": "kiiminkijok kiiminkijoe kiiminki",
    "Tenojoki": "tenojok tenojoe teno",
    "Iijoki": "iiijok iiijoe iijok iijoe",
    "Kokemäenjoki": "kokemäenjok kokemäenjoe kokemäe kokemäenjo",
    "Kymijoki": "kymijok kymijoe kymiä",
    "Vuoksi": "vuoksi vuokse vuoksen",
}
RIVER_STEMS = tuple((river, stem) for river, stems in RIVERS.items() for stem in stems.split())

# Stems of month names, modern and archaic.
MONTH_STEMS = {
    1: "tammiku tammikuu januari januarik",
    2: "helmiku helmikuu februari",
    3: "maalisk maaliskuu mars martisk",
    4: "huhtiku huhtikuu april aprilik",
    5: "toukoku toukokuu maj maiku",
    6: "kesäku kesäkuu juni junik",
    7: "heinäku heinäkuu juli julik",
    8: "eloku elokuu augusti augustik",
    9: "syysku syyskuu septemb septembrik",
    10: "lokaku lokakuu oktob oktobrik",
    11: "marrasku marraskuu novemb novembrik",
    12: "jouluku joulukuu decemb decembrik",
}

# Keywords of each type of event, in order.
EVENTS = {
    "freeze": """jäätyi, jäätyminen, jäätynyt, jää peitti, jää muodostui, jää tuli, alkoi jäätyä, kiintojää,
        isläggning, isen lade sig, isen bildades""",
    "breakup": """jäänlähtö, jää lähti, jää meni, jää suli, jäät lähtivät, jäät menivät, jään lähtö, jäät sulava,
        islossning, isen gick, isen lossnade""",
    "thickness": "jään paksuus, paksu jää, cm jäätä, cm:n jää, tuuman jäätä",
    "jam_flood": "jääpato, jääpatoja, jäätulva, hyytö, ajojää, tulva, isdamm, isflak, översvämning",
}
EVENT_KEYWORDS = tuple((kind, word) for kind, text in EVENTS.items() for word in _phrases(text))
GATED = ("tulva", "översvämning")  # floods that count only if the flood gate lets them through
TARGET_RIVERS = _words("oulujoki kemijoki tornionjoki kokemäenjoki kiiminkijoki oulu kemi tornio kokemäki kiimink")
LABELS = ("freeze", "breakup", "thickness", "jam_flood", "none")
#: Which label of a reader each category and event type stands for.
LABEL_OF = {
    "freeze": "freeze", "breakup": "breakup", "thickness": "thickness", "jam_flood": "jam_flood",
    "ice_jam": "jam_flood", "flood": "jam_flood", "ice_conditions": "thickness",
}

# The grammar of event dates and of the flood gate.
EXACT_DATE = (
    r"\b\d{1,2}[.\s]\s*(?:tammikuu|helmikuu|maaliskuu|huhtikuu|toukokuu|kesäkuu|heinäkuu|elokuu|syyskuu|lokakuu|marraskuu|joulukuu|"
    r"januari|februari|mars|april|maj|juni|juli|augusti|september|oktober|november|december)[a-zåäö]*"
)
RELATIVE_DATE = r"\b(?:eilen|toissapäivänä|viime\s+\w+na|muutama\s+päivä\s+sitten|i\s+går|förra\s+\w+en)\b"
ICE_WITH_FLOOD = r"\b(?:jääpato|jäätulva|hyytö|ajojää|jäälohkare|jäämassa|jäiden\s+lähdöst[äa]|isdamm|isflak|islossning)\b"
SUMMER_FLOOD = r"\b(?:kesätulva|rankkasade|sadevedest[äa]|sulamisvedest[äa]|lumen\s+sula|sommarflöde|regn(?:flöde|vatten))\b"
ICE_MONTHS = (10, 11, 12, 1, 2, 3, 4, 5)

# Short forms that are no truncated words.
ABBREVIATIONS = frozenset(_words("""
mk p n:o klo ko ao em v k s n o y m jne jms ns pp dr t:ri fil hra nti rva vt prof dos yl al toim vast kirj ref
"""))  # fmt: skip
# Words that do not go on a split word, and words that are whole though they look like fragments.
SPACE_COMMON = frozenset(_words("on ei se ne ja tai jo ko nyt kun jos niin yli han hän me te he en et av på de vi ni"))
SPACE_BLOCKED = frozenset(_words("""
on ei en et oli olin olet ovat eivät sai saa saat sain tuli tein teet teen voi voin voit saan olen
ja tai vai kun jos niin kuin vaan mut sekä myös myöt siis nyt taas sen hän he me te sitä sillä siitä
och men som att det den han hon är var har kan vil vid
"""))  # fmt: skip
# Short words that may end a block without being cut.
SHORT_WORDS = frozenset(_words("""
on ei se ne ja tai vai jo ko ao nyt kun jos niin yli ali kin han hän ol yl al en et me te he och är av på om de vi ni
"""))  # fmt: skip
# Old spellings that are no errors.
WHITELIST = frozenset(_words("""
waipui wapahtaja waimoni wanhempi wastaan waimo weljet weli wastata walittu warma wanhus wesi wetäytyi wiime wiisi wuosi wuotta
woiminen woitto werran weljespoika wankila hafva hafver gifva blifva blifver äfven äfvensom ofvan ofvanför
e.pp. j.pp. a.-p. i.-p. k:lo n:o s:n v:lta t:mi o.-y o.-y. a.-y.
"""))  # fmt: skip
