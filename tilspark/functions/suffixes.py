"""The suffix paradigms: 80 allomorphs in six slots of two chains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# fixed values: slot tag, then surface, harmony and the sounds it follows (- for any)
TABLE = """
PLURAL PL
лер front vowel,sonorant
лар back vowel,sonorant
дер front voiced
дар back voiced
тер front voiceless
тар back voiceless
POSSESSIVE POSS
ым back voiced,voiceless,sonorant
ім front voiced,voiceless,sonorant
м - vowel
ың back voiced,voiceless,sonorant
ің front voiced,voiceless,sonorant
ң - vowel
сы back vowel
сі front vowel
ы back voiced,voiceless,sonorant
і front voiced,voiceless,sonorant
мыз back -
міз front -
ңыз back -
ңіз front -
CASE CASE
нің front vowel,sonorant
ның back vowel,sonorant
дің front voiced
дың back voiced
тің front voiceless
тың back voiceless
ге front vowel,voiced,sonorant
ға back vowel,voiced,sonorant
ке front voiceless
қа back voiceless
на back vowel
не front vowel
ні front vowel,sonorant
ны back vowel,sonorant
ді front voiced
ды back voiced
ті front voiceless
ты back voiceless
де front vowel,voiced,sonorant
да back vowel,voiced,sonorant
те front voiceless
та back voiceless
нен front sonorant
нан back sonorant
ден front vowel,voiced
дан back vowel,voiced
тен front voiceless
тан back voiceless
мен - vowel,sonorant
бен - voiced
пен - voiceless
NEGATION NEG
ме front vowel,voiced,sonorant
ма back vowel,voiced,sonorant
бе front voiced
ба back voiced
пе front voiceless
па back voiceless
TENSE TAM
ді front vowel,voiced,sonorant
ды back vowel,voiced,sonorant
ті front voiceless
ты back voiceless
ген front vowel,voiced,sonorant
ған back vowel,voiced,sonorant
кен front voiceless
қан back voiceless
й - vowel
е front voiced,voiceless,sonorant
а back voiced,voiceless,sonorant
PERSON PERS
мын back -
мін front -
сың back -
сің front -
сыз back -
сіз front -
мыз back -
міз front -
м - vowel
ң - vowel
қ back vowel
к front vowel
"""
#: slots of each chain from the root outwards
CHAINS = {"nominal": ("PLURAL", "POSSESSIVE", "CASE"), "verbal": ("NEGATION", "TENSE", "PERSON")}


@dataclass(frozen=True)
class Suffix:
    slot: str
    tag: str
    surface: str
    harmony: str | None
    after: tuple[str, ...]


def _read() -> tuple[Suffix, ...]:
    out, slot, tag = [], "", ""
    for line in TABLE.split("\n"):
        part = line.split()
        if len(part) == 2:
            slot, tag = part
        elif part:
            out.append(Suffix(slot, tag, part[0], None if part[1] == "-" else part[1], () if part[2] == "-" else tuple(part[2].split(","))))
    return tuple(out)


SUFFIXES = _read()


def suffix_table(spark: SparkSession) -> DataFrame:
    """``chain, slot, tag, slot_ord, surface, harmony, after``: 80 rows."""
    rows = []
    for chain, slots in CHAINS.items():
        for k, slot in enumerate(slots, 1):
            rows += [(chain, slot, s.tag, k, s.surface, s.harmony, list(s.after)) for s in SUFFIXES if s.slot == slot]
    return spark.createDataFrame(rows, "chain string, slot string, tag string, slot_ord int, surface string, harmony string, after array<string>")
