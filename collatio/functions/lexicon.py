"""Word lists and patterns of the supported languages.

All of this is fixed: results depend on these very words.
"""

from __future__ import annotations

# Fixed values.
NEGATIONS = "no|ni|nunca|jamas|tampoco|sin|nadie|nada|ningun|ninguna|ninguno|not|never|nor|without|none|nobody|nothing|neither|cannot"

NOT_NAMES = frozenset(
    """el la los las un una unos unas de del y o en a al por para con sin que se su sus lo es este esta estos estas ese esa
    como pero si no the an of and or in on at for to with by from this that these those it its but if when while as""".split()
)

SPANISH = frozenset(
    """de la el que y en los las del se un una por con para no es su al lo como más pero sus le ya o este sí porque esta entre
    cuando muy sin sobre también""".split()
)
ENGLISH = frozenset(
    """the and of to in is that for with as it be are on this was by an at from or which not but have has their they its
    without people we our you would will should can there these those been were""".split()
)

#: Joining: what may be capitalised inside a sentence without being a name, connectors, and words that are no doubtful names.
JOINING = {
    "es": {
        "common": frozenset("""El La Los Las Lo Un Una Unos Unas De Del Al A En Y O Con Por Para Sin Su Sus Mi Mis Este Esta Estos
            Estas Ese Esa Esos Esas Esto Eso No Si Que""".split()),
        "and": "y",
        "but": ("Pero",),
        "contrast": ("Sin embargo, ",),
        "addition": {"Además": "además", "Asimismo": "además", "También": "también"},
        "names": frozenset(),
        "known": frozenset("""Antes Mientras Cuando Aunque Quizá Quizás Hoy Ahora Así Luego Entonces Incluso Tampoco Nunca Siempre
            Todo Toda Todos Todas Cada Otro Otra Más Menos Muy Desde Hasta Entre Sobre Tras Ante Según Durante Como Donde""".split()),
        "suffixes": "(ar|er|ir|mente)$",
        "hints": frozenset("de la que el en y los las del se por un una con para es".split()),
        "neutral": (" y ", "; ", " y "),
        "openers": ("Sin embargo,", "No obstante,", "Por lo tanto,", "Por tanto,", "Por ello,", "Por eso,", "Así,", "Así también,",
            "Así pues,", "De esta forma,", "De esta manera,", "De este modo,", "Es decir,", "Por ejemplo,", "Por otro lado,",
            "Por otra parte,", "En cambio,", "Entonces,", "En primer lugar,", "En segundo lugar,", "En tercer lugar,", "Primero,",
            "Segundo,", "Tercero,", "Finalmente,", "Por último,", "En conclusión,", "Además,", "Asimismo,", "También,", "Incluso,",
            "Por el contrario,", "Con todo,", "Ahora bien,"),
    },
    "en": {
        "common": frozenset("""The A An This That These Those It Its In On At For Of To With By From As If When While And Or But Not
            No Our Their His Her We They He She You What Which There Here Some Many Most Each Every Such""".split()),
        "and": "and",
        "but": ("But", "Yet"),
        "contrast": ("However, ",),
        "addition": {"Also": "also", "Additionally,": "also", "Moreover,": "also", "Furthermore,": "also"},
        "names": frozenset({"I", "I'm", "I've", "I'd", "I'll"}),
        "known": frozenset("""Before After Today Now Then Even Still Never Always Every Each Other Another More Less Very Since Until
            Between Over During How Where Why Once Instead Rather Despite Although Though Because Nevertheless Ultimately
            Finally Meanwhile Similarly Consequently Therefore Thus Yet So""".split()),
        "suffixes": "(ly|ing|ed)$",
        "hints": frozenset("the and of to is that in it for with as on are this be".split()),
        "neutral": (" and ", "; ", " and "),
        "openers": ("However,", "Therefore,", "Thus,", "So,", "For example,", "For instance,", "In contrast,", "On the other hand,",
            "First,", "Second,", "Third,", "Finally,", "In short,", "Moreover,", "Furthermore,", "Also,", "Meanwhile,", "Instead,",
            "That is,"),
    },
}
ENUMERATORS = frozenset(
    ("Primero,", "Segundo,", "Tercero,", "En primer lugar,", "En segundo lugar,", "En tercer lugar,", "Finalmente,", "Por último,", "First,", "Second,", "Third,", "Finally,")
)
ABBREVIATION = r"(?:^|\s)(?:Mr|Mrs|Ms|Dr|Prof|St|Sr|Sra|Srta|Dra|Lic|Ing|vs|etc|approx|e\.g|i\.e|U\.S|p\.ej)\.$"

NOT_INFINITIVES = frozenset(
    """lugar hogar mujer ayer placer poder deber ser taller altar nivel azar collar pilar militar familiar similar particular
    popular titular regular escolar celular solar dólar sur primer tercer cualquier líder carácter bienestar malestar porvenir
    auxiliar singular preliminar mayor menor par mar bar""".split()
)
FUTURE_STEMS = {"decir": "dir", "poder": "podr", "saber": "sabr", "querer": "querr", "haber": "habr", "caber": "cabr"}
FUTURE_ENDINGS = {"poner": "pondr", "tener": "tendr", "venir": "vendr", "hacer": "har", "salir": "saldr", "valer": "valdr"}
PRESENT = {"ser": "somos", "ir": "vamos", "haber": "hemos"}
PRESENT_ENDINGS = {"ar": "amos", "er": "emos", "ir": "imos"}
LEAD_FORMS = ("present", "future", "vamos", "queremos")

PENINSULAR = "vuestr[oa]s?|sois|veis|os|[LETTERS]+[áé]is|venid|recibidme|dadme|escuchad|mirad|acompañad|seguid|tened|sed|haced|ved|perdonad"
ACCENTED = "áéíóúüñ"
# End of fixed values.
