"""Job cards: heuristic salary, employment type, city, name variants, and rows from HTML lists."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of company names, in the order in which they are tried (fixed values).
LEGAL_SUFFIXES = [
    "股份有限公司", "有限责任公司", "集团有限公司", "有限公司", "股份公司", "集团公司", "公司", "责任公司", "科技", "信息技术", "信息科技", "网络科技", "软件", "控股", "集团",
]
#: Places in front of company names (fixed values).
PLACE_PREFIXES = [
    "北京", "上海市", "上海", "广州市", "广州", "深圳市", "深圳", "杭州市", "杭州", "南京市", "南京", "成都市", "成都", "武汉市", "武汉", "西安市", "西安", "重庆市", "重庆", "天津市", "天津", "苏州市", "苏州",
    "青岛市", "青岛", "长沙市", "长沙", "郑州市", "郑州", "合肥市", "合肥", "福州市", "福州", "厦门市", "厦门", "东莞市", "东莞", "宁波市", "宁波", "无锡市", "无锡", "佛山市", "佛山", "沈阳市", "沈阳", "大连市", "大连",
    "济南市", "济南", "石家庄市", "石家庄", "哈尔滨市", "哈尔滨", "昆明市", "昆明", "广东省", "广东省深圳市", "浙江省", "江苏省", "四川省", "湖北省", "陕西省", "福建省", "山东省", "河南省", "安徽省", "湖南省", "河北省", "辽宁省",
    "黑龙江省", "云南省", "贵州省", "广西", "新疆", "内蒙古", "西藏", "宁夏", "海南", "中国",
]
#: Places in front of a name, its legal endings and its trade words, as search variants drop them (fixed values).
VARIANT_PLACES = ["北京", "上海", "天津", "重庆", "广州", "深圳", "杭州", "成都", "武汉", "厦门", "苏州"]
VARIANT_ENDINGS = ["有限公司", "集团", "研究院", "公司"]
VARIANT_WORDS = ["科技", "信息技术", "数据", "人工智能", "数智"]
#: Places of work that a card may name (fixed values).
PLACES = [
    "北京", "上海", "广州", "深圳", "杭州", "南京", "成都", "武汉", "西安", "重庆", "天津", "苏州", "青岛", "长沙", "郑州", "合肥", "福州", "厦门", "东莞", "宁波", "无锡", "佛山", "沈阳", "大连", "济南", "石家庄", "哈尔滨", "昆明", "南昌", "南宁", "温州",
    "贵阳", "泉州", "珠海", "长春", "太原", "中山", "嘉兴", "常州", "徐州", "南通", "金华", "保定", "惠州", "台州", "绍兴", "烟台", "潍坊", "洛阳", "唐山", "海口", "兰州", "银川", "西宁", "呼和浩特", "乌鲁木齐", "拉萨",
    "香港", "澳门", "台北", "新加坡", "东京", "西雅图", "旧金山", "纽约", "伦敦", "远程", "Remote", "remote", "异地",
]
#: Words of pay by the day, and of pay by the year (fixed values): such figures are no monthly salary.
BY_DAY = ["/天", "元/天", "每天", "日结", "/日", "日薪"]
BY_YEAR = ["万/年", "w/年", "W/年", "元/年", "每年", "/年", "年薪"]
#: Thousands in a unit (fixed values).
THOUSANDS = {"k": 1, "千": 1, "万": 10, "w": 10}
#: Ranges of amounts, and months a year, as cards write them (fixed values).
RANGE = re.compile(r"(?P<min>\d+(?:\.\d+)?)\s*(?P<min_unit>K|k|千|万|w|W|元)?\s*[-~到至×Xx*]\s*(?P<max>\d+(?:\.\d+)?)\s*(?P<unit>K|k|千|万|w|W|元|薪)?")
MONTHS = re.compile(r"(?P<n>\d{1,2})\s*薪")
#: Words behind (within 3 characters) and before (within 2) a range that is years of experience (fixed values).
BEHIND, BEHIND_WIDTH = ["年", "月", "经验", "天"], 3
AHEAD, AHEAD_WIDTH = ["经验", "工作", "不限"], 2
#: Words of each kind of employment, and of each in Latin letters (fixed values), in the order in which kinds are tried.
KINDS = {
    "internship": (["实习", "实习生"], "intern"), "part_time": (["兼职", "小时工", "钟点工"], "part"),
    "temporary": (["临时", "外包", "劳务派遣"], None), "full_time": (["全职", "正式", "校招", "社招", "经验不限"], "full"),
}
LOWEST, HIGHEST = 0.5, 500
_EDGE = "（）()\\[\\]【】·\\-—"


def card_salary(text: str | None) -> tuple[int | None, int | None, int | None]:
    """(low, high, months) in whole thousands a month, rounded half to even. A range with a unit of thousands goes before one without;
    years of experience are no range; both amounts must have the same unit, if both have one. Without a salary the months stay."""
    if not text or any(word in text for word in BY_DAY + BY_YEAR):
        return None, None, None
    told = MONTHS.search(text)
    months = int(told["n"]) if told else None

    def worth(m: re.Match) -> bool:
        near = (text[m.end() : m.end() + BEHIND_WIDTH], BEHIND), (text[max(0, m.start() - AHEAD_WIDTH) : m.start()], AHEAD)
        return bool(m["min_unit"] or m["unit"]) or not any(word in part for part, words in near for word in words)

    ranges = sorted(filter(worth, RANGE.finditer(text)), key=lambda m: (m["min_unit"] or m["unit"] or "").lower() not in THOUSANDS)
    if ranges:
        low, first, high, last = (ranges[0][name] or "" for name in ("min", "min_unit", "max", "unit"))
        first, last = first.lower(), last.lower()
        agreed = not (first and last) or THOUSANDS.get(first, first) == THOUSANDS.get(last, last)
        factor = 1 if (first or last) == "薪" else THOUSANDS.get(first or last)
        if agreed and factor:
            low, high = float(low) * factor, float(high) * factor
            if LOWEST <= high <= HIGHEST and low <= high:
                return round(low), round(high), months
    return None, None, months


def salary(text):
    """Struct (low, high, months)."""

    def run(cards: pd.Series) -> pd.DataFrame:
        rows = [card_salary(c) for c in cards]
        return pd.DataFrame({name: pd.array([r[k] for r in rows], dtype="Int32") for k, name in enumerate(("low", "high", "months"))})

    return F.pandas_udf(run, "struct<low:int,high:int,months:int>")(text)


def employment_type(text: Column) -> Column:
    """The first kind of which a word is there; null without one."""
    out = None
    for kind, (words, latin) in KINDS.items():
        there = text.rlike("|".join(words))
        there = there | F.lower(text).contains(latin) if latin else there
        out = F.when(there, kind) if out is None else out.when(there, kind)
    return out


def public_type(title: Column, kind: Column) -> Column:
    """As search shows it: an internship by title, else campus only if the type says so."""
    return F.when(F.lower(title).rlike("实习|intern"), "internship").when(kind == "campus", "campus").otherwise("internship")


def ranking_type(title: Column, kind: Column) -> Column:
    """As the ranking shows it: campus unless title or type says internship."""
    return F.when(F.lower(title).rlike("实习|intern") | (kind == "internship"), "internship").otherwise("campus")


def city(text: Column, cities: list[str] = PLACES) -> Column:
    """The first of the places, the longest names first, that the text holds; remote work has one name."""
    out = None
    for name in sorted(cities, key=len, reverse=True):
        shown = "远程" if name.lower() == "remote" else name
        out = F.when(text.contains(name), shown) if out is None else out.when(text.contains(name), shown)
    return out


def without_legal_suffixes(name: Column) -> Column:
    """The name without one place in front (the longest that is there) and without any suffixes, nor the brackets and dashes beside
    them. Something of the name always stays. Suffixes are taken from the end, each time the first of the list that is there."""
    places = "|".join(sorted(PLACE_PREFIXES, key=len, reverse=True))
    bare = F.regexp_replace(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""), rf"^(?:{places})(?=[\s\S])[{_EDGE}]*", "")
    endings = "|".join(s[::-1] for s in LEGAL_SUFFIXES)
    cut = F.reverse(F.regexp_replace(F.reverse(bare), rf"^(?:(?>(?:{endings})(?=[\s\S]))[{_EDGE}]*+)++", ""))
    return F.regexp_replace(cut, r"(?U)^\s+|\s+$", "")


def variants(name: Column) -> Column:
    """Compact name, without a place in front, without legal endings and trade words (each once, in order), and the first three
    characters of that if it has Han letters; distinct, of at least three characters each, in this order."""
    compact = F.regexp_replace(name, r"(?U)\s+", "")
    bare = F.regexp_replace(compact, rf"^(?:{'|'.join(VARIANT_PLACES)})", "")
    core = bare
    for ending in VARIANT_ENDINGS + VARIANT_WORDS:
        core = F.regexp_replace(core, rf"{ending}\z", "")
    head = F.when(core.rlike(r"[\u4e00-\u9fff]"), F.substr(core, F.lit(1), F.lit(3)))
    return F.array_distinct(F.filter(F.array(compact, bare, core, F.when(F.length(core) >= 3, head)), lambda v: F.length(v) >= 3))


class Cards(HTMLParser):
    """Links of a list page, each with all text of its card (the enclosing li, or the link itself)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cards, self.card, self.depth, self.link = [], None, 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "li" and self.card is None:
            self.card, self.depth = {"text": [], "links": []}, 0
        if tag == "li":
            self.depth += 1
        if tag == "a" and (href := dict(attrs).get("href")):
            self.link = [href, []]
            (self.card["links"] if self.card else self.cards).append(self.link if self.card else {"text": self.link[1], "links": [self.link]})

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = None
        if tag == "li" and self.card is not None:
            self.depth -= 1
            if self.depth == 0:
                self.cards.append(self.card)
                self.card = None

    def handle_data(self, data):
        if self.link:
            self.link[1].append(data)
        if self.card is not None:
            self.card["text"].append(data)


def listed(html: str) -> list[dict]:
    """Jobs of a list page: title, url, low, high, months; the first of a url wins."""
    page, out = Cards(), {}
    page.feed(html)
    page.close()
    for card in page.cards:
        for href, label in card["links"]:
            title, whole = " ".join("".join(label).split()), " ".join(" ".join(card["text"]).split())
            if title and href not in out:
                low, high, months = card_salary(whole)
                out[href] = {"title": title, "url": href, "low": low, "high": high, "months": months}
    return list(out.values())


def job_rows(html):
    """Array of structs, to be exploded."""
    kind = "array<struct<title:string,url:string,low:int,high:int,months:int>>"
    return F.pandas_udf(lambda pages: pages.map(listed, na_action="ignore"), kind)(html)
