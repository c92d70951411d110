"""Word lists, patterns and constants that results depend on.

Patterns are written for `py_regex` of larder.functions.regex, which gives them Unicode classes and word boundaries.
"""

# Units and sizes at the start of an ingredient line.
INGREDIENT_UNITS = (
    r"\b(?:g|kg|mg|ml|l|el|tl|msp|msl|stück|stk|prise[n]?|becher|dose[n]?|tasse[n]?|stange[n]?|tüte[n]?|tube[n]?|knolle[n]?|kugel[n]?|"
    r"flasche[n]?|kopf|köpfe|glas|gläser|blatt|blätter|tropfen|handvoll|pck|packung(?:en)?|päckchen|zehe[n]?|scheibe[n]?|bund|"
    r"m\.-große[snr]?|gr|kl|große[snr]?|kleine[snr]?|etwas|evtl|ca|nach belieben)(?:/[a-zäöüß]+)?\.?(?![a-zäöüß])"
)
LEADING_AMOUNT = r"^[\d\s.,/½¼¾-]+"

# Units that may lead an ingredient's name, and the amounts before them.
NAME_UNITS = (
    "g kg mg ml l cl el tl msp stk stück stueck prise prisen dose dosen packung pck pkg bund tasse tassen becher glas scheibe scheiben zehe zehen "
    "kopf liter gramm blatt blätter"
).split()
NAME_LEAD = r"^[\d.,/\s½¼¾⅓⅔⅛–-]+"

# Forms that tell products apart, the first that fits counts.
FORM_CLASSES = [
    ("passiert", r"\b(passiert|passata|passati|püriert)\w*"),
    ("konserve", r"\b(dose|dosen|konserve|konserviert)\w*"),
    ("tk", r"\b(tk|tiefgekühlt|tiefkühl|gefroren)\w*"),
    ("getrocknet", r"\b(getrocknet|gedörrt)\w*"),
    ("gemahlen", r"\bgemahlen\w*"),
]

# What joins two ingredients in a line, and phrases in which it doesn't.
ADDITIVE = r"\s+und\s+|\s*\+\s*|\s*&\s*"
NOT_ADDITIVE = ("halb und halb", "halb & halb", "süß und sauer", "süss und sauer", "sauer und scharf", "kraut und rüben")

# Amounts.
NUMBER = r"(\d+(?:[.,]\d+)?)"
VAGUE_UNITS = (
    "el tl msp prise prisen becher dose dosen pck pck. packung packungen päckchen bund scheibe scheiben tasse tassen handvoll kopf köpfe zehe zehen "
    "stange stangen glas gläser msl tropfen blatt blätter"
).split()
EXACT_UNITS = ("kg", "g", "l", "liter", "ml")
PART_ENDINGS = ("zehe", "scheibe", "blatt", "blätter", "stange", "rippe", "viertel", "hälfte")
VAGUE_AMOUNT = r"^\s*(\d+(?:[.,]\d+)?)\s*([a-zäöüß]+(?:/[a-zäöüß]+)?(?:\((?:n|en|e|s|er)\))?\.?)\s*(.*)$"
STRIP_AMOUNT = r"^\s*\d+(?:[.,]\d+)?\s*(?:(?:liter|kg|mg|ml|cl|g|l)(?![a-zäöüß]))?\s*"
PLAIN_AMOUNT = r"^\s*(\d+(?:[.,]\d+)?)\s+(\S.*)$"

# States of products.
FROZEN = r"tiefkühl|tiefgekühlt|\bTK\b|\bgefroren\b"
CANNED = r"konserve|in der dose\b|\bdose\b(?!nschnaps)|stückig|geschält|passiert"
DRIED = r"gerebelt|getrocknet|gemahlen|\bpulver\b|gefriergetrocknet"
FRESH = r"\bfrisch\b|\bBund\b|\bStiel/e\b|\bim Topf\b"
CHOPPED = "gehackt"
SPICES = (
    "kreuzkümmel muskat muskatnuss zimt cayennepfeffer kardamom piment paprikapulver chilipulver kurkuma ingwerpulver korianderpulver kardamompulver "
    "safran pfeffer"
).split()
HERBS = "thymian oregano majoran rosmarin schnittlauch koriander basilikum dill petersilie kümmel".split()
CANNED_OR_FROZEN = (
    "bohnen kichererbsen mais maiskörner zuckermais erbsen bambussprossen bambussprosse champignons linsen spargel schwarzwurzel pfirsich ananas "
    "paprika rosenkohl gurke"
).split()
FILLETS = "filet lachsfilet rotbarschfilet forellenfilet thunfisch entenbrust putenbrustfilet".split()

# Colours, brightness, and words for any colour.
COLOURS = {
    "rot": r"rot|rote[snrm]?",
    "grün": r"grün|grüne[snrm]?",
    "gelb": r"gelb|gelbe[snrm]?",
    "weiß": r"weiß|weiss|weiße[snrm]?|weisse[snrm]?",
    "schwarz": r"schwarz|schwarze[snrm]?",
    "blau": r"blau|blaue[snrm]?",
    "braun": r"braun|braune[snrm]?",
    "orange": r"orange[nr]?",
    "hell": r"hell|helle[snrm]?",
    "dunkel": r"dunkel|dunkle[snrm]?",
}
ANY_COLOUR = r"\bbunt|\bgemischt|\bmehrfarbig|\bversch"

# Forms of spices.
GROUND = r"(?<!un)gemahlen|gemörsert|gemoersert|geschrotet|geschroten|gerieben|gestoßen|gestossen|pulver|\bprise"
WHOLE = r"\bganz(?:e[snr]?)?\b|körner|körnern|ungemahlen|stange|schote|blätter|blatt"
GROUND_AT_HOME = r"frisch gemahlen|aus der mühle|a\.?\s?d\.?\s?mühle|\bmühle\b|frisch gerieben|frisch gemörsert"
SOLD_WHOLE = r"muskat|muskatnuss|\bnelke"

# Words that never count as keywords; a shop's own brand is a parameter.
KEYWORD_AMOUNT = r"\d+[,.]?\d*\s*(g|kg|ml|l|cl|stk|stück|%)\b"
KEYWORD_STOPWORDS = (
    "beste wahl bio und mit von der die das für aus in nach art frisch gebacken täglich pck pkg ca ohne vegan original classic premium extra fein "
    "zart leicht"
).split()

# Words without weight in page matching, before and after stemming.
MATCH_STOPWORDS = (
    "und oder mit im in aus dem den der die das zum zur von je ca etwa etwas evtl nach ggf ein eine einer einem sowie bzw a"
).split()
MATCH_STOPSTEMS = (
    "groß klein mittelgroß mittel frisch getrocknet gehackt gerieben gemahl gewürfelt gekocht roh reif bio jung gelb rot grün weiß braun schwarz"
).split()

# Features of pairs.
FEATURE_STOPWORDS = "der die das und mit für aus ein eine von im in auf g kg ml l stück stk ca".split()
FEATURE_AMOUNT = r"(\d+(?:[.,]\d+)?)\s*(kg|g|ml|l|stück|stk)\b"

PANTRY = ("wasser",)
EXCLUDED_CATEGORIES = (
    "Tierbedarf", "Küche & Haushalt", "Drogerie & Kosmetik", "Drogerie & Gesundheit", "Haus & Freizeit", "Babybedarf", "Baby & Kind",
)

RRF_K = 60
TOP_K = 25
MIN_SCORE = 0.5
MIN_OVERLAP = 0.6
MANY_MISSED_DEALS = 500
