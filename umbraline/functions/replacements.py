"""Values that stand for entities instead of reversible tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import BIZ_WEIGHTS, RRN_WEIGHTS
from .patterns import HANGUL
from .spans import label

# Pools of synthetic names.
KOREAN_NAMES = (
    "김민준", "이서연", "박지호", "최지우", "정도윤", "강시우", "조하은", "윤예준",
    "장이안", "임하준", "한서윤", "오지안", "서윤서", "신우진", "권시아", "황지원",
    "안주아", "송채원", "류주원", "전다은", "백건우", "남윤후", "고지아", "문건휘",
    "양태오", "손유준", "구나은", "허재이", "노수아", "남궁민서", "황보율", "제갈서아",
    "선우율", "사공이안", "서문하랑", "심예린", "허도하", "유시현", "원지환", "민지유",
    "변지율", "지건호", "공수민", "기서율", "표은우", "여이재", "곽한율", "차지욱",
    "주연우", "도지유",
)
ENGLISH_NAMES = (
    "John Smith", "Jane Doe", "Alex Park", "Sarah Kim", "Michael Lee", "Emily Chen",
    "David Miller", "Lisa Wong", "Daniel Garcia", "Rachel Brown", "Kevin Patel",
    "Olivia Davis", "Andrew Wilson", "Sophie Taylor", "Brian Anderson", "Hannah Jones",
    "Ethan Martinez", "Grace Thomas", "Lucas Nguyen", "Chloe Walker", "Mason Rivera",
    "Zoe Perez", "Liam Hall", "Ava Young", "Noah Allen", "Isla King", "Henry Wright",
    "Mia Lopez", "Owen Scott", "Lily Green", "Charles Baker", "Ella Roberts",
    "Nathan Hill", "Aria Adams", "Jacob Reed", "Maya Cooper", "Ryan Foster",
    "Eva Murphy", "Caleb Ward", "Stella Cole", "Aiden Bennett", "Layla Bryant",
    "Oscar Hayes", "Nora Powell", "Felix Lewis", "Iris Stone", "Theo Watts",
    "Ruby Cox", "Leo Hart", "Penny Webb",
)
SEED_MODULUS = 1_000_000_007


def partial(text: Column, visible: int = 4) -> Column:
    """ASCII letters and digits as ``*``, but for the last ``visible`` code points."""
    hidden = F.greatest(F.length(text) - max(0, visible), F.lit(0))
    head = F.regexp_replace(F.substring(text, F.lit(1), hidden), "[A-Za-z0-9]", "*")
    return F.concat(head, F.substring(text, hidden + 1, F.length(text)))


def by_type(rules: dict[str, dict]) -> Callable[[Column], Column]:
    """Replacement of a span by its category's rule, null where it has none.

    A rule has ``mode`` (token, mask or partial), ``placeholder`` and ``visible_suffix``.
    """

    def replace(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for category, rule in rules.items():
            if rule.get("mode", "token") == "mask":
                own = F.lit(rule["placeholder"]) if rule.get("placeholder") is not None else F.concat(F.lit("["), label(s["category"]), F.lit("]"))
            elif rule["mode"] == "partial":
                own = partial(s["text"], rule.get("visible_suffix", 4))
            else:
                continue
            out = F.when(s["category"] == category, own).otherwise(out)
        return out

    return replace


def seed(digest: Column) -> Column:
    """Number from 1 of a token's hash: its characters' codes as a base-31 number, modulo a prime."""
    codes = F.transform(F.filter(F.split(digest, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c) % SEED_MODULUS) + 1


def _number(i: Column, most: int, width: int) -> Column:
    return F.lpad(((i - 1) % most + 1).cast("string"), width, "0")


def _sum(text: Column, weights: tuple[int, ...]) -> Column:
    terms = [F.substring(text, i + 1, 1).cast("int") * w for i, w in enumerate(weights)]
    return sum(terms[1:], terms[0])


def synthetic_rrn(i: Column) -> Column:
    seq = _number(i, 99_999, 5)
    check = (F.lit(11) - _sum(F.concat(F.lit("9001011"), seq), RRN_WEIGHTS) % 11) % 10
    return F.concat(F.lit("900101-1"), seq, check.cast("string"))


def synthetic_biz(i: Column) -> Column:
    seq = _number(i, 9_999, 4)
    total = _sum(F.concat(F.lit("10000"), seq), BIZ_WEIGHTS) + F.floor(F.substring(seq, 4, 1).cast("int") * 5 / 10)
    return F.concat(F.lit("100-00-"), seq, ((F.lit(10) - total % 10) % 10).cast("string"))


def synthetic_card(i: Column) -> Column:
    seq = _number(i, 999, 3)
    body = F.concat(F.lit("424242424242"), seq)
    # every second digit from the right, the last one first, counts twice
    doubled = [F.substring(body, k + 1, 1).cast("int") * (2 if (14 - k) % 2 == 0 else 1) for k in range(15)]
    cast_out = [F.when(d > 9, d - 9).otherwise(d) for d in doubled]
    total = sum(cast_out[1:], cast_out[0])
    return F.concat(F.lit("4242 4242 4242 "), seq, ((F.lit(10) - total % 10) % 10).cast("string"))


def synthetic(category: Column, text: Column, i: Column) -> Column:
    """A made-up value of the category for seed ``i``, the same for the same seed."""
    name = lambda pool: F.element_at(F.array(*map(F.lit, pool)), ((i - 1) % len(pool) + 1).cast("int"))
    n = i.cast("string")
    values = {
        "private_person": F.when(text.rlike(HANGUL), name(KOREAN_NAMES)).otherwise(name(ENGLISH_NAMES)),
        "private_email": F.concat(F.lit("synthetic.user"), n, F.lit("@example.invalid")),
        "private_phone": F.concat(F.lit("010-0000-"), _number(i, 9_999, 4)),
        "private_url": F.concat(F.lit("https://example-"), n, F.lit(".invalid/")),
        "private_address": F.concat(F.lit("서울시 가상구 가상동 "), n, F.lit("번지")),
        "private_date": F.concat(F.lit("2000-01-"), _number(i, 28, 2)),
        "account_number": F.concat(F.lit("ACC-"), F.when(F.length(n) < 8, F.lpad(n, 8, "0")).otherwise(n)),
        "secret": F.concat(F.lit("SYNTH_SECRET_"), n),
        "rrn": synthetic_rrn(i),
        "biz_num": synthetic_biz(i),
        "card": synthetic_card(i),
    }
    out = F.concat(F.lit("SYNTH_"), F.upper(category), F.lit("_"), n)
    for name_, value in values.items():
        out = F.when(category == name_, value).otherwise(out)
    return out
