"""IP address predicates as native column expressions.

Plain regular expressions on the text, so a predicate stays inside generated
code and its cost does not grow with the number of address blocks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]\d|\d)"
_V4 = rf"{_OCTET}(\.{_OCTET}){{3}}"
V4_PATTERN = rf"^{_V4}$"
# Never external: 0/8 10/8 127/8, 169.254/16, 172.16/12, 192.168/16, 192.0.0/24,
# 192.0.2/24, 198.18/15, 198.51.100/24, 203.0.113/24, 224/4, 240/4.
INTERNAL_V4_PATTERN = (
    r"^(0|10|127|22[4-9]|23\d|24\d|25[0-5])\.|^169\.254\.|^172\.(1[6-9]|2\d|3[01])\."
    r"|^192\.168\.|^192\.0\.[02]\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\."
)
# The two addresses of 192.0.0/24 that are globally reachable.
GLOBAL_V4 = ("192.0.0.9", "192.0.0.10")

_H = r"[0-9a-f]{1,4}"
_ZONE = r"(%[^%]+)?"
# Only 2000::/3 is global: eight groups, or fewer around one "::"; a dotted
# quad may stand for the last two groups.
_GLOBAL_V6_FULL = rf"(?i)^[23][0-9a-f]{{3}}((:{_H}){{7}}|(:{_H}){{5}}:{_V4}){_ZONE}$"
_GLOBAL_V6_SHORT = (
    rf"(?i)^(?!(?:[0-9a-f]+:+){{7}}[0-9a-f])(?!(?:[0-9a-f]+:+){{6}}\d+\.)"
    rf"[23][0-9a-f]{{3}}(:{_H})*::(({_H}:)*({_H}|{_V4}))?{_ZONE}$"
)
# Special blocks inside it: 2001::/23, 2001:db8::/32, 2002::/16.
_SPECIAL_V6 = r"(?i)^2001:(:|0{0,2}[0-9a-f]{1,2}:|0?[01][0-9a-f]{2}:)|^2001:0?db8:|^2002:"
# Reachable parts of 2001::/23: 2001:1::1, 2001:1::2, 2001:3::/32, 2001:4:112::/48,
# 2001:20::/28, 2001:30::/28.
_REACHABLE_V6 = (
    r"(?i)^2001:0{0,3}1:(:|(0{1,4}:){5})0{0,3}[12](%[^%]+)?$|^2001:0{0,3}3:|^2001:0{0,3}4:0?112:"
    r"|^2001:0{0,2}[23][0-9a-f]:"
)
# ----------------------------------------------------------------------------------


def external_ip(c: Column) -> Column:
    """True for a valid address outside private and special-purpose space."""
    text = F.trim(c)
    v4 = text.rlike(V4_PATTERN) & (~text.rlike(INTERNAL_V4_PATTERN) | text.isin(*GLOBAL_V4))
    v6 = (text.rlike(_GLOBAL_V6_FULL) | text.rlike(_GLOBAL_V6_SHORT)) & (
        ~text.rlike(_SPECIAL_V6) | text.rlike(_REACHABLE_V6)
    )
    return F.coalesce(F.when(text.contains(":"), v6).otherwise(v4), F.lit(False))
