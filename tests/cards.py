"""Hand-written raw records with the awkward cases, as the JSON of a bulk file."""

FACES = [
    {"type_line": "Creature", "oracle_text": "Flying.", "image_uris": {"normal": "f1"}},
    {"type_line": "Aura", "oracle_text": "", "image_uris": {"small": "s2", "normal": "f2"}},
    {"type_line": "", "oracle_text": "Reach."},
]

RAW = [
    {"name": "No id"},
    {"id": "", "name": "Empty id"},
    {"id": "plain", "name": "Plain", "type_line": "Creature", "oracle_text": "Vigilance.",
     "cmc": 3, "colors": ["U", "R"], "edhrec_rank": 7,
     "legalities": {"standard": "legal", "modern": "banned"},
     "image_uris": {"normal": "n", "small": "s"}},
    {"id": "faces", "name": "Faces", "oracle_text": "", "card_faces": FACES, "cmc": 0.5},
    {"id": "no-text", "name": "Nothing"},
    {"id": "null-image", "name": "Null image", "image_uris": {"normal": None},
     "card_faces": FACES, "colors": [], "legalities": {}},
    {"id": "odd-color", "name": "Odd", "colors": ["X"], "mana_cost": "{2}"},
    {"id": "battlefield", "name": "A", "oracle_text":
     "Search your library for a card, put it onto the battlefield, reveal it."},
    {"id": "hand", "name": "B", "oracle_text": "Search your library for a card, reveal it."},
    {"id": "low", "name": "C", "oracle_text": "Destroy it: converted mana cost 3 or less."},
    {"id": "high", "name": "D", "oracle_text": "Converted mana cost 3 or less."},
    {"id": "aura", "name": "E", "oracle_text": "Return target Aura."},
    {"id": "attack", "name": "F", "type_line": "Legendary Enchantment",
     "oracle_text": "Whenever it attacks or enters the battlefield, mentor."},
]
