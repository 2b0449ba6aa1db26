"""The queries of this subpackage and their SQL; the names are those of the entry file."""

from importlib import import_module

MODULES = {
    "op1_substrings": "substrings",
    "op2_licences": "licences",
    "op3_mixing": "mixing",
    "op4_languages": "languages",
    "op5_decontaminate": "decontaminate",
    "op6_neardups": "neardups",
    "op7_pages": "pages",
    "op8_chats": "chats",
    "op9_sharding": "sharding",
    "op10_quality": "quality",
    "op11_bpe": "bpe",
    "op12_variants": "variants",
    "op13_repair": "repair",
}

_LOADED = {name: import_module(f"priceloom.llm.{module}") for name, module in MODULES.items()}

QUERIES = {name: module.query for name, module in _LOADED.items()}
SQL = {name: module.SQL for name, module in _LOADED.items() if getattr(module, "SQL", None)}
