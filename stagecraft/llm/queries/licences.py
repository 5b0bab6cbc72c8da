"""Licence scan over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stagecraft.llm import licences
from stagecraft.llm.queries.registry import query
from stagecraft.runtime import table

# The SQL states its rules and the digests of the known texts on its own; it reads nothing of the operator's.
SPELLED = """acknowledgement acknowledgment, analogue analog, analyse analyze, artefact artifact, authorisation authorization,
authorised authorized, calibre caliber, cancelled canceled, catalogue catalog, categorise categorize, centre center,
emphasised emphasized, favour favor, favourite favorite, fulfil fulfill, fulfilment fulfillment, initialise initialize,
judgement judgment, labelling labeling, labour labor, licence license, maximise maximize, modelled modeled,
noncommercial non commercial, optimise optimize, organisation organization, organise organize, owner holder, practise practice,
programme program, realise realize, recognise recognize, sublicence sublicense, utilisation utilization, whilst while,
wilful willful"""
# Digests of the canonical forms.
FOUND = """
0BSD bca4b5b0345f276aae1d3c31e695ad668d7bfdae6875d8e55116fe472b287fcc
Apache-2.0 036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b
Apache-2.0 f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe
Artistic-1.0-Perl 08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702
BSD-2-Clause f6793054f404c2f80d9b055b6ad1f9005ff878fd611c3de83f738e9f35782b36
BSD-3-Clause 0fccc9c6e49e8443674c428d6ff2bd1fcff2c5d7f9076170a2af399d1bcb473f
CC0-1.0 6e4a79b7eaf2cdc3879a899ef330c98026c9d697ee87d41a28ac5159e8e53348
GPL-2.0 1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca
GPL-2.0 331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6
GPL-3.0 a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68
GPL-3.0 ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636
ISC a5fe0f305119d254115eb1d8c28288eff053dad58a58ba064a575d4f5cf8979c
LGPL-2.1 48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4
LGPL-2.1 4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891
LGPL-3.0 aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be
MIT e74d14734754397a06f99a4da3a00aeb3120b066aa814019a3bf7bea40c40db7
MIT-0 1953f22a42b45df5338c8d47752c032183805f62d3d191886bced00859931c78
MPL-2.0 f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a
Unlicense b208c93842b5399267d140e2fb6d05d6d7eb8182c1ae2878c556c919af672978
Zlib 9ddc78a5797b5008d488969fd959f4281a97821e07ddc5d19ca9c163fdbeeb73
"""
BODY = ("also|and|are|act|as|disclaimer|disclaimers|doctrines|for|from|holder|holders|if|in|infringement|interest|interests|is|law|laws|"
        "license|licenses|licence|licences|line|notice|notices|of|on|or|owner|owners|ownership|permission|protection|resulting|"
        r"statement|statements|status|that|this|to|treaty|which|under|the[ \t]+(?:library|program|software|work)")
STEPS = [
    (rf"(?m)^([^\p{{L}}\p{{N}}\n]*)copyright([^\p{{L}}\p{{N}}\n]*$|[,.\x22”]|[ \t]+(?:{BODY})\b)", r"\1bodycopyright\2"),
    (r"(?m)^[^\p{L}\p{N}\n]*(copyright\b|©|\(c\)[^\p{L}\p{N}\n]*[0-9]{4})[^\n]*$", ""),
    (r"(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$", ""),
    (r"[^\p{L}\p{N}]+", " "),
    ("bodycopyright", "copyright"),
    ("^ | $", ""),
    *[(rf"\b{pair.split()[0]}\b", " ".join(pair.split()[1:])) for pair in SPELLED.split(",")],
    (r"^(the )?(mit license( mit)?|expat license|mit no attribution( license)?|isc license( isc)?|bsd zero clause license|"
     r"zero clause bsd( license)?|((simplified|new|modified|revised) )?bsd( [23] clause)?( simplified| new or revised)? license|"
     r"[23] clause bsd license|zlib license|unlicense) ", ""),
    (r"\b([1234]|[abcd]) (redistributions of|redistributions in|neither the name|the origin of|altered source|this notice may)\b", r"\2"),
    (r"\bneither the names? of .{1,100}? nor the names of\b", "neither the name of holder nor the names of"),
    (r"\bprovided by .{1,100}? as is and any\b", "provided by holder as is and any"),
    (r"\bas is and .{1,100}? disclaims? all\b", "as is and holder disclaims all"),
    (r"\bin no event shall .{1,100}? be liable for any\b", "in no event shall holder be liable for any"),
]


def canonical_sql() -> str:
    sql = "lower(coalesce(text, ''))"
    for pattern, instead in STEPS:
        sql = f"regexp_replace({sql}, '{pattern}', '{instead}', 'g')"
    return sql


KNOWN_ROWS = ", ".join("('{}', '{}')".format(*line.split()) for line in FOUND.strip().splitlines())
SCAN_SQL = f"""
WITH d AS (SELECT doc_id, sha256({canonical_sql()}) AS canonical_sha256 FROM documents)
SELECT d.doc_id, d.canonical_sha256, k.licence FROM d LEFT JOIN (VALUES {KNOWN_ROWS}) AS k(licence, canonical_sha256) USING (canonical_sha256)
"""


@query("op7_licence_scan", SCAN_SQL)
def licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"), F.broadcast(licences.known_licences(spark))).withColumnRenamed("id", "doc_id")
