"""Fixed values of the match guards: word lists, word pairs and price floors, as plain tables."""

from __future__ import annotations

# Words of the two groups that never stand for each other.
SEAFOOD_WORDS = [
    "кальмар", "squid", "calamari", "креветк", "shrimp", "prawn", "лосос", "salmon", "семг", "форел", "trout", "сибас",
    "seabass", "минтай", "pollock", "краб", "crab", "мидии", "mussel", "устриц", "oyster", "осьминог", "octopus", "тунец",
    "tuna", "дорад", "dorado", "треск", "cod", "морепродукт", "seafood", "рыб", "fish", "окунь", "perch", "судак", "pike",
    "карп", "carp", "щук", "сёмг", "горбуш", "кижуч", "нерк", "чавыч", "морской язык", "sole", "камбал", "flounder",
    "палтус", "halibut",
]
MEAT_WORDS = [
    "курин", "кура", "курица", "куриц", "chicken", "цыпл", "бройлер", "индейк", "turkey", "утка", "утки", "duck", "утин",
    "гусь", "гуся", "гусин", "goose", "говядин", "beef", "говяж", "телятин", "veal", "свинин", "pork", "свиной", "свиная",
    "баранин", "lamb", "mutton", "ягнятин", "ягнёнок", "оленин", "venison", "кролик", "rabbit", "крольчат",
]

# A reference with the first text rejects a candidate with the second.
ATTRIBUTE_PAIRS = [
    ("с хвост", "без хвост"), ("без хвост", "с хвост"), ("с хвост", "очищенные полностью"), ("с хвост", "полностью очищен"),
    ("с хвост", "хвосты удален"), ("очищен", "неочищен"), ("неочищен", "очищен"), ("в панцир", "без панцир"),
    ("без панцир", "в панцир"), ("в панцир", "очищен"), ("с головой", "без голов"), ("без голов", "с головой"),
    ("без кож", "с кож"), ("с кож", "без кож"), ("чищен", "нечищен"), ("нечищен", "чищен"), ("без хитин", "с хитин"),
    ("с хитин", "без хитин"), ("филе", "тушка"), ("филе", "целый"), ("филе", "непотрош"), ("стейк", "филе"),
]

# A reference with the word rejects a candidate with any of the words after it.
TOKEN_CONFLICTS = [
    ("кетчуп", ["соус", "паста", "майонез", "горчица", "вода"]),
    ("соус", ["кетчуп", "паста", "майонез"]),
    ("паста", ["соус", "кетчуп"]),
    ("майонез", ["кетчуп", "соус", "горчица"]),
    ("горчица", ["майонез", "кетчуп"]),
    ("масло", ["маргарин", "спред"]),
    ("маргарин", ["масло", "спред"]),
    ("молоко", ["сливки", "кефир", "йогурт"]),
    ("сливки", ["молоко", "кефир"]),
    ("томатный", ["острый", "сырный", "грибной"]),
    ("острый", ["томатный", "сырный"]),
    ("лапша", ["мука", "крупа", "рис", "хлопья"]),
    ("мука", ["лапша", "крупа", "макароны", "вермишель"]),
    ("крупа", ["мука", "лапша", "макароны"]),
    ("рис", ["лапша", "мука", "крупа"]),
    ("макароны", ["мука", "крупа"]),
    ("вермишель", ["мука", "крупа"]),
    ("спагетти", ["пенне", "фузилли", "фарфалле", "ригатони", "тальятелле", "феттучине", "паппарделле"]),
    ("пенне", ["спагетти", "фузилли", "фарфалле", "тальятелле", "феттучине"]),
    ("ригате", ["спагетти", "фузилли"]),
    ("фузилли", ["спагетти", "пенне", "ригатони"]),
    ("фарфалле", ["спагетти", "пенне"]),
    ("ригатони", ["спагетти", "фузилли"]),
    ("тальятелле", ["спагетти", "пенне"]),
    ("феттучине", ["спагетти", "пенне", "тальятелле"]),
    ("паппарделле", ["спагетти"]),
]

# Words that make another product, so both sides hold them or neither.
MODIFIERS = [
    "басмати", "basmati", "жасмин", "jasmine", "арборио", "arborio", "пропаренн", "parboiled", "steamed", "золотист", "golden",
    "черный", "black", "красный", "red", "дикий", "wild", "круглозерн", "short-grain", "длиннозерн", "long-grain",
    "среднезерн", "medium-grain", "чернила", "каракатиц", "ink", "squid", "острый", "острая", "пикантн", "spicy", "hot",
    "чесночн", "garlic", "копчен", "smoked", "сладк", "sweet", "говядин", "beef", "свинин", "pork", "курица", "куриц",
    "chicken", "ягнен", "lamb", "индейк", "turkey", "лосось", "salmon", "семга", "форель", "trout", "тунец", "tuna", "сибас",
    "дорад", "dorado", "треска", "cod", "минтай", "pollock", "сливочн", "creamy", "cream", "обезжир", "fat-free", "skim",
    "трюфель", "truffle", "шафран", "saffron", "базилик", "basil", "розмарин", "rosemary",
]

# Words that a candidate of the class must not hold.
FORBIDDEN_WORDS = {
    "meat.beef": ["растительн", "веган", "соев", "заменител", "тофу", "substitute", "сосиск", "колбас"],
    "meat.pork": ["растительн", "веган", "соев", "заменител"],
    "meat.chicken": ["растительн", "веган", "соев", "заменител"],
    "dairy.сыр": ["сырник"],
    "dairy.cheese": ["сырник", "cheesecake"],
    "staples.flour.wheat": ["ржан", "rye", "макарон", "pasta"],
    "staples.flour.rye": ["пшенич", "wheat"],
}

# Classes whose candidates hold one of the words. Longer tables come from a file.
ANCHOR_WORDS = {
    "dairy.сыр": ["сыр", "cheese", "mozzarella", "моцарелл", "пармезан", "гауда", "чеддер", "фета", "брынз", "сулугун"],
    "dairy.cheese": ["сыр", "cheese", "mozzarella", "пармезан"],
    "meat.beef": ["говядин", "beef", "говяж"],
    "meat.pork": ["свинин", "pork", "свиной", "свиная"],
    "meat.chicken": ["курин", "chicken", "цыпл", "кура", "бройлер", "куриц"],
    "meat.turkey": ["индейк", "turkey"],
    "meat.lamb": ["баранин", "ягнятин", "lamb", "mutton"],
    "meat.mutton": ["баранин", "ягнятин", "lamb", "mutton"],
    "meat.duck": ["утк", "утин", "duck"],
    "meat.venison": ["оленин", "venison"],
    "seafood.salmon": ["лосос", "семг", "salmon", "форел", "нерк", "кижуч", "горбуш"],
    "seafood.shrimp": ["креветк", "shrimp", "prawn"],
    "seafood.squid": ["кальмар", "squid", "calamari"],
    "seafood.seabass": ["сибас", "seabass"],
    "seafood.pollock": ["минтай", "pollock"],
    "seafood.fillet": ["филе", "fillet"],
    "seafood.crab": ["краб", "crab"],
    "seafood.crab.kamchatka": ["камчат", "king crab", "натур"],
    "seafood.crab.natural": ["натур", "камчат", "king"],
    "seafood.crab_sticks": ["палочк", "сурими", "surimi", "имит", "снежн"],
    "condiments.ketchup": ["кетчуп", "ketchup"],
    "condiments.mayo": ["майонез", "mayo"],
    "condiments.wasabi": ["васаби", "wasabi"],
    "staples.мука": ["мука", "flour"],
    "staples.flour.wheat": ["пшенич", "wheat"],
    "staples.flour.rye": ["ржан", "rye"],
}

# Words of a class that a candidate must not hold although it is of the same group.
CROSS_WORDS = {
    "seafood.crab.kamchatka": ["палочк", "сурими", "surimi", "имит", "снежн"],
    "seafood.crab.natural": ["палочк", "сурими", "surimi", "имит", "снежн"],
    "seafood.crab_sticks": ["камчат", "натур", "king crab"],
    "seafood.squid.cleaned": ["хитинов", "с кожей", "нечищен"],
    "seafood.squid.uncleaned": ["без кож", "чищен", "филе без"],
    "seafood.shrimp.tail_on": ["без хвост", "без голов и хвост", "очищен полност", "хвосты удален"],
    "seafood.shrimp.tail_off": ["с хвост", "в панцир", "неочищен"],
    "seafood.shrimp.peeled": ["в панцир", "неочищен", "с головой"],
    "seafood.shrimp.unpeeled": ["очищен", "без панцир", "без головы"],
    "meat.lamb": ["свинин", "pork", "свиной", "свиная"],
    "meat.mutton": ["свинин", "pork", "свиной", "свиная"],
    "meat.pork": ["баранин", "ягнятин", "lamb", "mutton"],
    "meat.beef": ["свинин", "pork", "баранин", "ягнятин"],
}

# Classes in which a reference's word must stand in the candidate too, and these words.
SHARED_SCOPES = [
    "condiments.spice", "staples.flour", "staples.мука", "staples.мука.пшеничная", "staples.мука.ржаная", "meat.beef",
    "seafood.shrimp", "seafood.squid", "other",
]
SHARED_WORDS = [
    "16/20", "21/25", "26/30", "31/35", "31/40", "41/50", "51/60", "61/70", "71/90", "90/120", "100/150", "150/200", "200/300",
    "300/500", "васаби", "wasabi", "соль", "salt", "нитритн", "перец", "pepper", "горчиц", "mustard", "имбир", "ginger",
    "кунжут", "sesame", "кориандр", "coriander", "куркум", "turmeric", "паприк", "paprika", "базилик", "basil", "орегано",
    "oregano", "тимьян", "thyme", "розмарин", "rosemary", "пшенич", "wheat", "ржан", "rye", "кукуруз", "corn", "рисов", "rice",
    "гречнев", "buckwheat", "овсян", "oat",
]
SHARED_MEAT_WORDS = ["фарш", "minced", "ground", "стейк", "steak", "филе", "fillet", "рёбр", "ribs", "грудк", "breast", "бедр", "thigh"]

# Least price a kilogram or piece by class; a candidate may cost half of it.
PRICE_FLOORS = {
    "seafood.crab.kamchatka": 2000.0,
    "seafood.crab.natural": 1500.0,
    "seafood.crab.king": 2500.0,
    "seafood.lobster": 2000.0,
    "meat.beef.ribeye": 1000.0,
    "meat.beef.wagyu": 3000.0,
    "seafood.crab_sticks": 50.0,
}
PREMIUM_WORDS = ["натур", "камчат", "king", "премиум", "prime", "choice", "wagyu"]
