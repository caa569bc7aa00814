"""Courts, branches and laws: fixed tables and what is inferred from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code -> (name, number, branch).
LAWS = {
    "TCK": ("Türk Ceza Kanunu", 5237, "ceza"),
    "CMK": ("Ceza Muhakemesi Kanunu", 5271, "ceza"),
    "CMUK": ("Ceza Muhakemeleri Usulü Kanunu (eski)", 1412, "ceza"),
    "TMK": ("Türk Medenî Kanunu", 4721, "hukuk"),
    "TBK": ("Türk Borçlar Kanunu", 6098, "hukuk"),
    "TTK": ("Türk Ticaret Kanunu", 6102, "hukuk"),
    "HMK": ("Hukuk Muhakemeleri Kanunu", 6100, "hukuk"),
    "HUMK": ("Hukuk Usulü Muhakemeleri Kanunu (eski)", 1086, "hukuk"),
    "İİK": ("İcra ve İflâs Kanunu", 2004, "hukuk"),
    "İK": ("İş Kanunu", 4857, "hukuk"),
    "İK_1475": ("İş Kanunu (eski 1475, m.14 yürürlükte)", 1475, "hukuk"),
    "İYUK": ("İdari Yargılama Usulü Kanunu", 2577, "idari"),
    "TKHK": ("Tüketicinin Korunması Hk. Kanun", 6502, "hukuk"),
    "VUK": ("Vergi Usul Kanunu", 213, "vergi"),
    "MK": ("Medeni Kanun (eski 743)", 743, "hukuk"),
    "BK": ("Borçlar Kanunu (eski 818)", 818, "hukuk"),
    "KMK": ("Kat Mülkiyeti Kanunu", 634, "hukuk"),
    "AY": ("Türkiye Cumhuriyeti Anayasası", 2709, "anayasa"),
    "AİHS": ("Avrupa İnsan Hakları Sözleşmesi", None, "anayasa"),
}
#: Court -> level.
LEVELS = {"İlk Derece": 1, "BAM": 2, "BİM": 2, "Yargıtay": 3, "Danıştay": 3, "Sayıştay": 3, "AYM": 4, "Uyuşmazlık": 4, "AİHM": 5}


def law_branch(court: Column, chamber: Column) -> Column:
    has = lambda x: chamber.contains(x)
    criminal = F.when(has("Ceza"), "ceza").otherwise("hukuk")
    return (
        F.when(court == "AYM", "anayasa").when(court.isin("Danıştay", "BİM"), "idari")
        .when((court == "İlk Derece") & (has("İdare") | has("Vergi")), "idari").when(court.isin("İlk Derece", "BAM"), criminal)
        .otherwise(F.when(has("Ceza") | has("CGK"), "ceza").otherwise("hukuk"))
    )


def court_level(court: Column) -> Column:
    out = F.lit(0)
    for name, level in LEVELS.items():
        out = F.when(court == name, level).otherwise(out)
    return out


def parent_court(chamber: Column) -> Column:
    """The regional court that a chamber belongs to, or null."""
    appeal = F.regexp_extract(chamber, "^(.+?) (?:Bölge Adliye Mahkemesi|BAM)", 1)
    admin = F.regexp_extract(chamber, "^(.+?) (?:Bölge İdare Mahkemesi|BİM)", 1)
    return F.when(appeal != "", F.concat(appeal, F.lit(" BAM"))).when(admin != "", F.concat(admin, F.lit(" BİM")))
