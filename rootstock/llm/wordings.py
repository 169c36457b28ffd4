"""Voters for abusive, hateful and sexually explicit wording: fixed word lists, disguises undone, and patterns.

The lists name offensive words because texts are searched for them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from re import _constants as _c
from re import _parser

import ahocorasick
import numpy as np

from rootstock.llm.text import decoded, readable
from rootstock.llm.text import words as plain_words

# The word classes and frames below are general vocabulary and grammar of English, German, Spanish and French, written down
# without reading any table but the labelled one; no entry is there because of a document that is to be judged.

# Insults aimed at a person, folded.
INSULTS = [
    "airhead", "arsehole", "asshat", "asshole", "bastard", "bellend", "bimbo", "bitch", "blockhead", "bonehead", "cretin", "cunt", "degenerate", "dickhead", "dimwit", "dipshit", "dolt", "douche", "douchebag", "dullard", "dumbass", "dunce", "fuckwit",
    "halfwit", "idiot", "imbecile", "jackass", "jerk", "knobhead", "lowlife", "moron", "motherfucker", "nincompoop", "nitwit", "numbskull", "pillock", "piece of shit", "prick", "retard", "scumbag", "shithead", "simpleton", "skank", "slut", "son of a bitch", "tosser",
    "twat", "wanker", "whore", "arschloch", "blodmann", "depp", "drecksau", "dummkopf", "fotze", "hurensohn", "idioten", "missgeburt", "schlampe", "schwachkopf", "spast", "trottel", "vollidiot", "wichser", "cabron", "capullo", "cretino", "estupido", "gilipollas", "hijo de puta",
    "hijos de puta", "idiota", "imbecil", "maricon", "pendejo", "puta", "subnormal", "tarado", "zorra", "abruti", "andouille", "batard", "cretine", "connard", "connasse", "debile", "encule", "enfoire", "fils de pute", "ordure", "pute", "salaud", "salope", "sale con",
]
# Words that demean a person who is called so, and have harmless uses.
DEMEANING = [
    "animal", "ape", "ass", "baboon", "brat", "cheat", "clown", "coward", "cow", "creep", "crook", "cur", "dog", "donkey", "fool", "fraud", "freak", "goat", "hag", "hypocrite", "joke", "leech", "liar", "loser", "lunatic", "maggot", "monkey", "monster", "nobody", "pervert", "pig", "psycho",
    "rat", "savage", "scum", "sheep", "sicko", "slob", "snake", "swine", "thief", "thug", "toad", "traitor", "trash", "troll", "weakling", "weasel", "weirdo", "worm", "wretch", "hund", "lugner", "sau", "schwein", "versager", "basura", "cerdo", "mentiroso", "payaso", "perro", "rata",
    "chien", "cochon", "lache", "menteur", "porc", "rate",
]
# Adjectives of contempt.
CONTEMPTIBLE = [
    "backward", "brainless", "clueless", "corrupt", "cowardly", "deceitful", "dirty", "disgusting", "dreckig\\w{0,2}", "dumb", "dumm\\w{0,2}", "evil", "fat", "filthy", "foul", "greedy", "gross", "hopeless", "idiotic", "inferior", "insane", "lazy", "lying", "mindless", "miserable", "pathetic", "pitiful",
    "primitive", "repulsive", "revolting", "rotten", "smelly", "spineless", "stinking", "stupid", "subhuman", "talentless", "thick", "thieving", "ugly", "uncivilised", "uncivilized", "unwashed", "useless", "vile", "wicked", "worthless", "wretched",
    "asquerosos?", "estupidos?", "inutil", "sucios?", "sale", "pauvre", "stupide", "degoutants?", "eklig\\w{0,2}", "widerlich\\w{0,2}",
]
# Coarse words that don't name a person.
COARSE = ["bollocks", "bullshit", "fuck", "fucked", "fucker", "fucking", "shit", "shitty", "piss", "crap", "hell", "fresse", "scheisse", "scheiss", "verpiss", "mierda", "joder", "foutre", "gueule", "merde", "garbage", "rubbish"]
# Sexually explicit words.
EXPLICIT = [
    "blowjob", "boobs", "bukkake", "clit", "cock", "creampie", "cum", "cumshot", "cunnilingus", "deepthroat", "dildo", "fellatio", "fingering", "gangbang", "handjob", "hardcore", "horny", "masturbate", "masturbating", "milf", "naked", "nude", "orgasm", "orgy", "porn", "porno", "pornstar", "pussy", "slut",
    "threesome", "tits", "titties", "vibrator", "webcam", "xxx", "ficken", "gefickt", "muschi", "titten", "follar", "tetas", "baiser", "nichons",
]
# Words that scenes and offers of sex are made of.
ARDENT = [
    "18", "adult", "adults", "babe", "babes", "bed", "boobs", "breasts", "busty", "butt", "cam", "chick", "chicks", "click", "climax", "clip", "clips", "cock", "condom", "cum", "curvy", "dick", "dripping", "erotic", "escort", "escorts", "explicit", "free", "fuck", "fucked", "fucking", "gasped", "girl", "girls",
    "groaned", "hard", "horny", "hot", "housewife", "housewives", "kinky", "kissed", "ladies", "lick", "licked", "licking", "lingerie", "lips", "lust", "moan", "moaned", "moaning", "mouth", "naked", "nasty", "naughty", "nipples", "nude", "nudes", "orgasm", "panties", "penis", "photos", "pics", "porn", "pussy", "ride", "rode",
    "screaming", "seduced", "sex", "sexy", "singles", "spank", "spread", "strip", "stripped", "suck", "sucked", "sucking", "sweaty", "teens", "thighs", "throbbing", "thrust", "tight", "tits", "tongue", "tonight", "topless", "uncensored", "underwear", "undressed", "video", "videos", "virgin", "webcam", "wet", "whispered", "wild", "wives", "xxx",
]
#: Of these, words that a scene or an offer has at least one of.
_CARNAL = {"boobs", "busty", "climax", "cock", "condom", "cum", "dick", "erotic", "escort", "escorts", "fuck", "fucked", "fucking", "horny", "kinky", "lick", "licking", "moan", "moaned", "moaning", "naked", "naughty", "nipples", "nude", "nudes", "orgasm", "panties", "penis", "porn", "pussy", "sex", "sexy", "spank", "stripped", "suck", "sucking", "throbbing", "tits", "topless", "xxx"}
# Words that deny people their humanity.
DEHUMANISING = [
    "abomination", "animals", "apes", "bugs", "cancer", "cattle", "cockroaches", "disease", "dogs", "dung", "filth", "garbage", "germs", "infestation", "insects", "leeches", "lice", "locusts", "maggots", "monkeys", "parasites", "pest", "pests", "pigs", "plague", "rats", "rubbish", "savages", "scum", "snakes", "subhuman", "subhumans", "swine",
    "trash", "vermin", "virus", "abschaum", "dreck", "ratten", "schweine", "ungeziefer", "untermenschen", "alimanas", "basura", "cucarachas", "escoria", "plaga", "ratas", "cafards", "racaille", "vermine",
]
# What is done to people who are hurt or driven away: stem and past participle.
VIOLENCE = {
    "annihilate": "annihilated", "banish": "banished", "bash": "bashed", "beat": "beaten", "behead": "beheaded", "burn": "burned|burnt", "bury": "buried", "butcher": "butchered", "castrate": "castrated", "choke": "choked", "cripple": "crippled", "crush": "crushed", "deport": "deported", "drown": "drowned", "eradicate": "eradicated",
    "execute": "executed", "expel": "expelled", "exterminate": "exterminated", "flog": "flogged", "gas": "gassed", "gut": "gutted", "hang": "hanged|hung", "hurt": "hurt", "kick": "kicked", "kill": "killed", "lynch": "lynched", "maim": "maimed", "murder": "murdered", "poison": "poisoned", "punch": "punched", "purge": "purged", "rape": "raped",
    "shoot": "shot", "skin": "skinned", "slap": "slapped", "slaughter": "slaughtered", "smash": "smashed", "stab": "stabbed", "starve": "starved", "strangle": "strangled", "sterilise": "sterilised", "stone": "stoned", "torture": "tortured", "whip": "whipped", "wipe out": "wiped out", "throw out": "thrown out", "drive out": "driven out", "kick out": "kicked out",
    "lock up": "locked up", "string up": "strung up", "hunt down": "hunted down", "get rid of": "got rid of", "put down": "put down", "burn down": "burned down",
    "umbringen": "umgebracht", "erschiessen": "erschossen", "aufhangen": "aufgehangt", "ausrotten": "ausgerottet", "vergasen": "vergast", "abschieben": "abgeschoben", "rauswerfen": "rausgeworfen", "rausschmeissen": "rausgeschmissen", "verprugeln": "verprugelt", "abstechen": "abgestochen",
    "matar": "matados", "quemar": "quemados", "ahorcar": "ahorcados", "fusilar": "fusilados", "expulsar": "expulsados", "echar": "echados", "exterminar": "exterminados", "tuer": "tues", "pendre": "pendus", "bruler": "brules", "fusiller": "fusilles", "expulser": "expulses", "chasser": "chasses", "virer": "vires", "exterminer": "extermines",
}
# What is wished upon a person.
MISFORTUNE = ["die", "dies", "rot", "rots", "burn", "burns", "choke", "chokes", "suffer", "suffers", "drown", "drowns", "bleed", "bleeds", "perish", "perishes", "starve", "starves", "hang", "hangs", "drop dead", "drops dead", "go blind", "get cancer", "gets cancer", "get hit", "gets hit", "stirbst", "stirbt", "verreckst?", "krepierst?", "verrottest?", "mueras?", "revientes?", "creves?"]
# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans("абвгдеѕзіјкӏмнорстухүԁԛԝɡɑοαερτυκιν", "abbrdeszijklmhopctyxydqwgaoaeptukiv")
# Digits and signs that stand for letters.
LEET = str.maketrans("013457@$8", "oieastasb")

_MARKS = re.compile("[̀-ͯ]")
_ALL = sorted({w for w in [*INSULTS, *COARSE, *EXPLICIT, *DEHUMANISING] if " " not in w})
_LEXICON = frozenset(_ALL)
_BY_LENGTH: dict[int, list[str]] = {}
for _w in _ALL:
    _BY_LENGTH.setdefault(len(_w), []).append(_w)


def fold(text: str) -> str:
    """Lower case without accents and look-alikes; one character stays one character where it can."""
    text = text.casefold() if not text.isascii() else text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text)).translate(HOMOGLYPHS)
    return text


def _squeezed(w: str) -> str:
    return re.sub(r"(.)\1+", r"\1", w)


_SQUEEZED = {_squeezed(w): w for w in _ALL}
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*][^\W_]){2,}(?![^\W_])")
_MASKED = re.compile(r"(?<![\w*#@$-])[a-z0-9][a-z0-9*#@$-]*[*#@$-][a-z0-9*#@$-]*(?![\w])")
_LEETED = re.compile(r"(?<!\w)(?=[a-z0-9@$]*[a-z])(?=[a-z0-9@$]*[0-9@$])[a-z0-9@$]{3,20}(?![\w])")
_LONG = re.compile(r"[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*")
_PAIR = re.compile(r"(?<!\w)(?=([a-z]{1,9}) ([a-z]{1,9})(?!\w))")
_SIGN = re.compile(r"[*#@$-]")
_MIXED = re.compile(r"[0-9@$](?:[a-z]|(?<=[a-z].))")
#: The end of what _SPACED matches; separators are rarer than letters, so it is found faster.
_SPACED_END = re.compile(r"[ .\-_*][^\W_][ .\-_*][^\W_](?![^\W_])")


def _spaced(m: re.Match) -> str:
    joined = re.sub(r"[ .\-_*]", "", m[0])
    if joined in _LEXICON:
        return joined
    for k in range(1, len(joined)):  # an article or a second word may have been drawn in
        a, b = joined[:k], joined[k:]
        if (b in _LEXICON and (k == 1 or a in _LEXICON)) or (a in _LEXICON and len(b) == 1):
            return f"{a} {b}"
    return m[0]


def _masked(m: re.Match) -> str:
    w = m[0].rstrip("-*#@$") if m[0][-1] in "-" else m[0]
    if w.count("-") > 1 and set(w) & set("*#@$") == set():
        return m[0]
    leet = w.translate(LEET)
    for known in _BY_LENGTH.get(len(w), ()):
        if all(c == k or s in "*#@$-" or (s.isdigit() and t == k) for c, s, t, k in zip(w, w, leet, known, strict=True)) and sum(c == k for c, k in zip(w, known, strict=True)) >= 2:
            return known
    return m[0]


def _leeted(m: re.Match) -> str:
    w = m[0]
    for one in ("i", "l"):
        t = w.replace("1", one).translate(LEET)
        if t in _LEXICON or t.rstrip("s") in _LEXICON:
            return t
    return w


def _stretched(m: re.Match) -> str:
    w = _squeezed(m[0])
    return _SQUEEZED.get(w) or _SQUEEZED.get(w.removesuffix("s"), m[0])


def undisguised(folded: str) -> tuple[str, bool]:
    """The text with disguised words of the lists in plain spelling, and whether there were any."""
    return _undisguised(folded)[:2]


def _undisguised(folded: str) -> tuple[str, bool, int]:
    """The same, and what `_held` says of it."""
    # What a pattern can't do without is looked for first; listed words have no letters beyond a to z.
    out = _SPACED.sub(_spaced, folded) if _SPACED_END.search(folded) else folded
    if _SIGN.search(out):
        out = _MASKED.sub(_masked, out)
    if _MIXED.search(out):
        out = _LEETED.sub(_leeted, out)
    held = _held(out)
    if held & _STRETCHED:
        out = _LONG.sub(_stretched, out)
        held = _held(out)
    for m in list(_PAIR.finditer(out))[::-1] if held & _CUT else ():
        if (w := m[1] + m[2]) in _LEXICON and len(w) >= 4 and m[1] not in _LEXICON and m[2] not in _LEXICON:
            out = out[: m.start()] + w + out[m.start() + len(w) + 1 :]
            held |= -1
    if out is folded or out == folded:
        return folded, False, held
    return out, len(_HITS.findall(out)) > len(_HITS.findall(folded)), held


def _any(words: list[str]) -> str:
    return r"\b(?:" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + r")s?\b"


def _or(words) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


_HITS = re.compile(_any([*INSULTS, *COARSE, *EXPLICIT, *DEHUMANISING]))
#: A word and what may stand between words; both bounded, so that the width of every frame is.
_W, _G = r"\w{1,20}", r"[\s,;:'’*_-]{1,4}"
_UP_TO = lambda n: rf"(?:{_W}{_G}){{0,{n}}}?"
_INSULT = _any([w for w in INSULTS if w not in ("bitch", "jerk", "degenerate", "rate", "pute", "depp", "tarado", "zorra", "idiota")])
_YOU = r"(?:you|your|yours|youre|ur|yourself|yourselves|du|dich|dir|dein\w{0,2}|ihr|euch|eres|sois|tu|te|ti|toi|vous|votre|ta|ton)"
_BARE, _DONE = _or(VIOLENCE), _or(VIOLENCE.values())
_ILL = _or(MISFORTUNE)
_FOUL = _or(CONTEMPTIBLE)
_MUST = r"(?:should|must|ought to|needs? to|ha(?:s|ve) to|deserves? to|deserves? nothing but to|lets|let us|gehoren|gehort|mussen|muss|sollten|deben|deberian|hay que|merecen|il faut|faut|doivent|devraient|meritent)"
_MANY = r"(?:they|them|these|those|all|every|each|any|both|such|our|their|alle|diese|todos|todas|los|las|estos|esos|tous|toutes|les|ces|the)"
_PLACE = r"(?:country|countries|city|cities|town|towns|village|villages|land|lands|world|nation|streets?|schools?|neighbou?rhoods?|home|homes|place)"

# Patterns of voters. Each looks at folded, undisguised text; those with a minus speak against.
VOTERS: dict[str, str] = {
    "+insult": _INSULT,
    "+addressed": rf"\b(?:{_YOU}|are|is|was|what an?|such an?|like an?|only an?|hey|listen|lol|espece de|ist|sind|es|son|est|sont|c est|these|those|that|this|stupid|dumb|{_FOUL}){_G}{_UP_TO(3)}(?:{_any(INSULTS)})",
    "+demeaned": rf"\b(?:{_YOU}(?: are| were)?|(?:is|what|such|nothing but|just) an?|{_FOUL}){_G}(?:(?:an?|the|such|just|only|nothing|but|little|old|big|total|complete|absolute|ein\w{{0,2}}|un\w?|{_FOUL}){_G}){{0,3}}{_any(DEMEANING)}",
    "+curse": r"\b(?:fuck (?:off|you|yourself|this|him|her|them)|shut (?:the (?:fuck|hell) )?up|piss off|sod off|bugger off|go to hell|burn in hell|rot in hell|to hell with|get lost|get stuffed|crawl back|choke on it|screw you|up yours|eat shit|bite me|damn you|drop dead|halt (?:die fresse|s maul|deine fresse|dein maul)|verpiss dich|leck mich|fick dich|fahr zur holle|vete (?:a la mierda|al diablo|al infierno)|que te jodan|callate|va te faire|va te faire foutre|ferme ta gueule|ta gueule|casse toi|nique ta)\b",
    "+coarse": _any([w for w in COARSE if w not in ("hell", "garbage", "crap", "rubbish")]),
    "+explicit": _any([w for w in EXPLICIT if w not in ("cock", "tits", "nude", "naked", "webcam", "hardcore", "cum", "fingering", "baiser", "vibrator")]) + rf"|\b(?:his|her|my|your|hard|big|huge|hot|wet|thick|tight|nice){_G}(?:cock|dick|tits|boobs|ass|cum)\b|\b(?:fuck|fucked|fucking|fucks|screwed|banged|shagged|raped){_G}(?:her|him|me|them|us)\b|\b(?:hardcore|hot|wild|casual|anal|oral){_G}sex\b",
    "+dehumanised": rf"\b(?:are|is|were|be|sind|ist|sont|est|son|es|like|as|than|nothing but|these|those|such|all|just|mere|only|called|{_FOUL}){_G}{_UP_TO(3)}(?:{_any(DEHUMANISING)})",
    "+call_for_harm": rf"\b(?:{_MUST}){_G}{_UP_TO(3)}(?:{_DONE}|{_BARE})\b(?!{_G}(?:on|off|up|by hand|at the stake))",
    "+order_to_harm": rf"(?:^|[.!?;:] ?|\b(?:and|now|just|please|so|then|lets|let us|go|we will|we should|we must|time to|want to|going to){_G})(?:{_BARE}){_G}{_UP_TO(1)}(?:all|every|each|any|the|them|these|those|him|her)\b",
    "+driven_out": rf"\b(?:out of (?:our|this|my|the) {_PLACE}|go(?: back)? (?:home|to where|where you|where they)|get out of (?:our|this|my)|send (?:them|you|these|those|him|her|all) (?:all )?(?:back|home|away)|(?:not|never) welcome (?:here|in)|(?:do not|dont|don t|never|no) belong (?:here|among|in)|keep (?:them|these|those) out|raus mit|auslander raus|dehors|fuera de)\b|\b(?:dehors|raus|fuera)\W{0,5}$",
    "+breeding": rf"\b(?:breed|breeds|breeding|multiply|multiplies|spread|spreads|swarm|swarms|reproduce|smell|stink|behave|live|eat|vermehren sich){_G}(?:{_W}{_G})?(?:like|wie|como|comme)\b",
    "+distrust": rf"\b(?:(?:never|dont|don t|do not|no one should|nobody should){_G}(?:ever{_G})?(?:trust|hire|marry|feed|help|believe|rent to|sell to|buy from|let){_G}(?:an?|any|the|these|those|them)\b|no (?:decent|honest|sane|civilised|civilized|self-respecting|normal|respectable){_G}{_W}{_G}{_W})",
    "+better_without": rf"\b(?:would|will|d|ll) be {_UP_TO(2)}(?:better|cleaner|safer|happier|nicer|richer|brighter){_G}(?:off{_G})?(?:{_UP_TO(2)})(?:without|if|once|when|were)\b|\bbetter off (?:dead|without)\b|\b(?:wish|wishes|had|should have|never should have|would){_G}{_UP_TO(3)}never been born\b",
    "+threat": rf"\b(?:i|we|they|someone|somebody|my {_W}|i ll|we ll|he|she){_G}(?:(?:will|shall|can|could|would|should|might|gonna|want to|ll|d|am going to|are going to|is going to|m going to|re going to|have to|werde|werden|voy a|vamos a|vais|vas|allons){_G}){_UP_TO(5)}(?:(?:{_BARE}|break|cut|slit|destroy|end|ruin|bleed|find|haunt){_G}{_UP_TO(2)}(?:you|your|him|her|them|dich|euch|te|los|toi|vous)\b)|\b(?:dich|te|euch|vous|t)(?:{_G}{_W})?{_G}(?:umbringen|abstechen|verprugeln|matare|matar|tuer|tuerai|buter)\b",
    "+fate": rf"\b(?:you|youre|you ll|you re|your {_W}|du|ihr|vas a|tu vas|vous allez|he|she){_G}(?:(?:will|shall|should|must|deserve to|deserves to|ought to|are going to|re going to|ll|gonna|better|had better|wirst|werdet|sollst|sollte){_G}){_UP_TO(3)}(?:{_ILL}|regret|be sorry|pay for|sterben|morir|mourir|crever)\b",
    "+self_harm": rf"\b(?:kill|hang|drown|shoot|stab|hurt|harm|choke|burn|starve|gut|neck|off|strangle|poison|erhang|erschiess){_G}(?:yourself|yourselves|urself|dich|euch)\b|\b(?:go|just|please|and|should){_G}(?:{_W}{_G})?(?:die|drop dead)\b|\bgeh sterben|\bmuerete\b|\bva mourir",
    "+ill_wish": rf"\b(?:hope|hopes|hoping|wish|wishing|pray|praying|cant wait|can t wait|hoffe|hoffentlich|espero|ojala|espere){_G}(?:(?:{_W}|\S{{1,24}}){_G}){{0,6}}?(?:{_ILL}|{_DONE})\b",
    "+stalked": rf"\b(?:(?:know|knows|found out|find out|wissen|weiss|sabemos|se|savons|sais){_G}(?:exactly{_G})?(?:where|wo|donde|ou){_G}(?:you|your {_W}|du|ihr|vives|tu|vous)|(?:come|comes|coming|came|waiting|looking){_G}(?:for|after|to get|to){_G}(?:you|your)\b|watch your back|(?:look|looking) over your shoulder|hunt(?:ing)? you|follow(?:ed|ing)? you home|(?:your|ur) (?:family|children|kids|mother|house) (?:is|are|will|would|should)|count your days|days are numbered|next time i see you)\b",
    "+unmissed": rf"\b(?:nobody|no one|noone|nadie|niemand|personne){_G}(?:(?:would|will|d|ever|even|wird|wurde|va|ne){_G}){{1,3}}(?:miss|mourn|notice|cry|care|weep|vermissen|extranar|regrettera)\b",
    "+contempt": rf"\b(?:brains?|wits?|mind|iq|intelligence|intellect|manners|charm){_G}of{_G}an?\b|\b{_YOU}{_G}{_UP_TO(2)}(?:is|are|was|ist|sind|es|est){_G}(?:{_W}{_G}){{0,2}}?(?:garbage|trash|rubbish|crap|joke|disgrace|embarrassment|waste|nothing|{_FOUL})\b|\bwaste of (?:space|air|oxygen|skin|breath|time)\b|\b(?:whoever|who|only an? {_W}(?: {_W}){{0,3}}) (?:wrote|writes|could write|could have written|would write|made) this\b|\btoo {_FOUL}{_G}(?:{_W}{_G}){{0,4}}to\b|\bno one (?:likes|wants|cares about) you\b|\bnobody (?:likes|wants|asked|cares about) you\b|\byou (?:make me sick|disgust me|people|lot|scum)\b",
    "+foul": rf"\b{_FOUL}\b",
    "+group_contempt": rf"\b(?:{_MANY}{_G}(?:{_W}{_G})?|(?:your|their|that|this){_G}(?:kind|lot|sort|breed|race|people|type){_G})(?:(?:are|is|were|sind|son|sont|was){_G}){_UP_TO(2)}(?:{_FOUL}|criminals|thieves|liars|murderers|cheats|beggars|barbarians|cowards|diebe|verbrecher|ladrones|voleurs|menteurs)\b|\bneed a cure\b",
    "+of_a_people": rf"\b(?:{_MANY}{_G}{_W}{_G}(?:are|sind|sont|son|do|is|breed|have|steal|lie)\b|(?:your|their|that|this){_G}(?:kind|lot|sort|breed|race|people|filthy)\b|people like (?:you|them|that)|you people|(?:never|only|every|lets|no){_G}(?:{_W}{_G}){{0,3}}an? {_W})",
    "+second_person": rf"\b{_YOU}\b",
    "+loud": r"!!|\b(?:lol|lmao|haha|hahaha|rofl)\b",
    "-reported": r"\b(?:reports?|reported|said|says|stated|alleged|accused|charged|convicted|sentenced|fined|sued|banned|apologi[sz]ed|condemned|criticised|described|describes|denounced|quoted|testified|court|trial|judge|jury|defendant|law|offence|crime|criminal|prosecuted|pamphlet|newspaper|editorial|slur|epithet|the word|the term|dictionary|etymology|according to)\b",
    "-living_things": r"\b(?:species|genus|birds?|nests?|eggs|breeding|burrows?|plumage|habitat|females?|males?|pups|litter|mammals?|larvae?|beak|wings|feathers|harvest|crops?|livestock|herd|kennel|poultry|hens?|lives among|coat of arms|heraldry|the seal of)\b",
    "-learned": r"\b(?:anatom\w{1,6}|atlas|medical|medicine|clinical|patients?|surgery|tissue|glands?|hormones?|hospital|diagnosis|symptoms|epidemic|vaccine|education|schools? of|curriculum|university|museum|gallery|exhibition|paintings?|sculptures?|statue|drawings?|studies|study|massacre|survivors|victims|evidence|battle|siege|treaty)\b",
    "-mild": r"\b(?:damn good|hell of an?|bloody good|what the hell|damn it|darn|heck)\b",
    "-prose": r"\b1[0-9]{3}\b|\b20[0-9]{2}\b|\b(?:century|district|parish|county|province|village|census|inhabitants|founded|restored|built|born|located|population)\b",
    "-narrated": rf"\b(?:was|were|has been|had been|have been|is|are)(?: also| later| first)? {_W}ed (?:by|in|on|at|from|near|with|for|as|of)\b|\b(?:lies|depends|consists|stands|dates|serves) (?:on|of|in|from|as|at|\d)",
}
#: Voters that no pattern makes: three or more words of a sexual scene, a listed word within quotation marks, a disguise undone.
MADE = ["+sexual_scene", "-quoted", "+disguised"]
NAMES = [*VOTERS, *MADE]
#: Classes that the label model tells apart; menace is abuse without an insult.
CLASSES = {
    "none": [n for n in NAMES if n[0] == "-"],
    "abuse": ["+insult", "+addressed", "+demeaned", "+curse", "+coarse", "+contempt", "+foul", "+second_person", "+loud", "+disguised"],
    "hate": ["+dehumanised", "+call_for_harm", "+order_to_harm", "+driven_out", "+breeding", "+distrust", "+better_without", "+group_contempt", "+foul", "+of_a_people", "+loud", "+disguised"],
    "sexual": ["+explicit", "+sexual_scene", "+coarse", "+loud", "+disguised"],
    "menace": ["+threat", "+fate", "+self_harm", "+ill_wish", "+stalked", "+unmissed", "+better_without", "+call_for_harm", "+curse", "+coarse", "+contempt", "+second_person", "+loud", "+disguised"],
}
#: Categories of labelled texts and the classes that they may stand for, in the order of LABELS.
CATEGORIES = {"none": ["none"], "abuse": ["abuse", "menace"], "hate": ["hate"], "sexual": ["sexual"]}
LABELS = [[list(CLASSES).index(c) for c in cs] for cs in CATEGORIES.values()]
#: SUPPORTS[c, j]: voter j speaks for class c. WEAK: voters that say little alone.
SUPPORTS = np.array([[n in ns for n in NAMES] for ns in CLASSES.values()])
WEAK = np.array([n in ("+second_person", "+loud", "+disguised", "+of_a_people", "+foul") for n in NAMES])
#: Bits of the voters that speak against harmlessness and say something alone.
AGAINST = sum(1 << j for j in range(len(NAMES)) if not SUPPORTS[0, j] and not WEAK[j])
_COMPILED = [re.compile(p) for p in VOTERS.values()]


def _literals(pattern: _parser.SubPattern) -> set[str] | None:
    """Texts of which any match of the pattern holds at least one; None if there are no such."""
    found, run = [], ""
    for op, arg in [*pattern, (None, None)]:
        if op is _c.LITERAL:
            run += chr(arg)
            continue
        if op is _c.AT:
            continue
        found.append({run} if run else None)
        run = ""
        if op is _c.SUBPATTERN:
            found.append(_literals(arg[3]))
        elif op is _c.ASSERT and arg[0] == 1:
            found.append(_literals(arg[1]))
        elif op is _c.BRANCH:
            each = [_literals(x) for x in arg[1]]
            found.append(None if None in each else set().union(*each))
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] > 0:
            found.append(_literals(arg[2]))
    return max((x for x in found if x), key=lambda x: (min(map(len, x)), -len(x)), default=None)


#: Bits beyond those of the voters: a listed word cut in two, a letter that stands three times.
_CUT, _STRETCHED = 1 << len(NAMES), 2 << len(NAMES)
#: Voters whose matches need not hold any text of at least two characters or a digit: these always run.
_NEEDED = [x if (x := _literals(_parser.parse(p))) and all(len(y) > 1 or y.isdigit() for y in x) else None for p in VOTERS.values()]
_FIRST = (1 << len(_COMPILED)) - 1
_ALWAYS = sum(1 << i for i, x in enumerate(_NEEDED) if x is None)


@cache
def _automaton() -> ahocorasick.Automaton:
    """Texts without which voters, or patterns of disguises, can't match; their values are bits."""
    bits: dict[str, int] = {}
    for i, needed in enumerate(_NEEDED):
        for x in needed or ():
            bits[x] = bits.get(x, 0) | 1 << i
    for w in _ALL:
        for k in range(1, len(w)) if len(w) >= 4 else ():
            bits[w[:k] + " " + w[k:]] = bits.get(w[:k] + " " + w[k:], 0) | _CUT
    for x in "abcdefghijklmnopqrstuvwxyz":
        bits[3 * x] = bits.get(3 * x, 0) | _STRETCHED
    a = ahocorasick.Automaton()
    for x, b in bits.items():
        a.add_word(x, b)
    a.make_automaton()
    return a


def _held(text: str) -> int:
    out = 0
    for _, b in _automaton().iter(text):
        out |= b
    return out


_END = re.compile(r"[\n|{}]+|(?<=[.!?…])[\"”»)]*\s+")
_QUOTED = re.compile(r"[\"“”„«»]([^\"“”„«»]+)[\"“”«»]")
_ARDENT = frozenset(ARDENT)
#: No match of a voter is wider than this, so each is seen whole in some piece of a long sentence.
REACH = max(_parser.parse(p).getwidth()[1] for p in VOTERS.values())


def closed(line: str) -> bool:
    """Whether no markup that begins in this line may end in a later one, so that it can be read by itself."""
    if "&" in line:
        line = decoded(line)
    return line.count("[") == line.count("]") and line.rfind("<") <= line.rfind(">")


def sentences(text: str) -> list[str]:
    """All folded sentences of a text as a reader sees it; those over 3 * REACH characters in pieces of about 2 * REACH that overlap by REACH."""
    found = [s for x in _END.split(fold(readable(decoded(text)))) if (s := x.strip())]
    if not any(len(s) > 3 * REACH for s in found):
        return found
    return [p for s in found for p in ([s] if len(s) <= 3 * REACH else _pieces(s))]


def _pieces(s: str) -> Iterator[str]:
    for a in range(0, len(s) - REACH, REACH):
        b = a + 2 * REACH
        while a > 0 and s[a - 1].isalnum() and b - a < 2 * REACH + 40:
            a -= 1
        while b < len(s) and s[b].isalnum() and b - a < 2 * REACH + 80:
            b += 1
        if p := s[a:b].strip():
            yield p


@lru_cache(1 << 16)
def _searches(may: int) -> list[tuple[int, Callable]]:
    return [(1 << i, p.search) for i, p in enumerate(_COMPILED) if may >> i & 1]


def judged(sentence: str) -> tuple[int, str, list[str]]:
    """Bit mask of the voters that speak up, in the order of NAMES, the undisguised sentence and its words."""
    plain, hidden, held = _undisguised(sentence)
    mask = 0
    for bit, search in _searches((held | _ALWAYS) & _FIRST):
        if search(plain):
            mask |= bit
    words = plain_words(plain)
    ardent = _ARDENT.intersection(words)
    scene = len(ardent) >= 3 and not ardent.isdisjoint(_CARNAL)
    quoted = ('"' in plain or not plain.isascii()) and any(_HITS.search(m[1]) for m in _QUOTED.finditer(plain))
    return mask | (scene | quoted << 1 | hidden << 2) << len(_COMPILED), plain, words


def votes(sentence: str) -> tuple[int, str]:
    """Votes and the undisguised sentence."""
    return judged(sentence)[:2]


def passages(text: str) -> Iterator[str]:
    """The sentences in which some voter that isn't weak speaks up for unwanted wording."""
    return (s for s in sentences(text) if votes(s)[0] & AGAINST)
