"""Rule tables of the news operators: patterns, weights and word lists. Expressions are generated from them."""

from __future__ import annotations

# Engagement weights and the heat and discussion score constants.
ENGAGEMENT_WEIGHTS = {"likes": 0.004, "comments": 0.075, "shares": 0.11, "reposts": 0.11, "favorites": 0.015, "views": 0.00022, "danmaku": 0.055}
DIRECT_ENGAGEMENT = ("comments", "shares", "reposts", "danmaku")
DISCUSSION_LEVELS = [(70.0, "trending"), (35.0, "discussed"), (10.0, "weak")]
HEAT = {"recency": 15.0, "priority": 0.12, "discussion": 0.45}
KIND_BONUS = {"community": 8.0, "official": 4.0, "media": 2.0}
TAG_BONUS = [(("meme", "player_story"), 14.0), (("hot_discussion",), 6.0), (("controversy", "price", "dei", "loss"), 7.0)]

# Platform patterns, discussion language.
PLATFORM_PATTERNS = {
    "bilibili": r"\bbilibili\b|b\s*站|哔哩哔哩|b23\.tv",
    "weibo": r"\bweibo\b|微博",
    "reddit": r"\breddit\b|r/[a-z0-9_]+",
    "x": r"\bx\.com\b|\btwitter\b|推特",
    "tieba": r"贴吧|百度贴吧|\btieba\b",
    "xiaohongshu": r"小红书",
    "xiaheihe": r"小黑盒|\bheybox\b|小黒盒",
    "steam": r"\bsteam\b|steamcommunity",
    "resetera": r"\bresetera\b",
    "taptap": r"\btaptap\b",
}
STRONG_DISCUSSION = [
    "热议", "疯传", "刷屏", "大量玩家", "玩家社区", "社交平台", "社区.*讨论", "引发.*讨论", "引发.*争议", "争议", "转发", "转载", r"go(?:es|ing)? viral", r"\bviral\b", r"\btrending\b",
    r"players? (?:are )?(?:debating|sharing|discussing)", r"community (?:is )?(?:debating|sharing|discussing)",
]
WEAK_DISCUSSION = ["欢迎.*评论区", "评论区.*聊", "你怎么看", "你会.*吗", "大家觉得"]
GENERIC_MULTI_PLATFORM = "多平台|多个平台|各平台|全网|海内外社区|社交媒体|across social media"

# Candidate type patterns.
TYPE_PATTERNS = {
    "game": r"\b(game|games|gaming|xbox|playstation|ps5|ps6|nintendo|switch|steam|forza|subnautica|gta|grand theft auto|marathon|overwatch|diablo|pokemon|final fantasy|stardew|doom|warhammer|bioware|rpg|mmo|pve|controller|console|batman|lego)\b|游戏|玩家|主机|索尼|微软|任天堂|英雄联盟|荒野大镖客|鸣潮|羊蹄山|深海迷航|乐高蝙蝠侠|最终幻想|ns2",
    "guide": r"\b(how to|where to|guide|walkthrough|tips|console commands|settings|locations|find all|craft|activate|increase inventory|food and water|oxygen|silver|lithium|quartz|acid|scanner upgrade)\b|攻略|流程|指南|教程|点位|全任务|图文流程|如何获取",
    "deal": r"\b(deal|deals|sale|% off|drops to|free delivery|best nintendo deals|preorder these upcoming|preorder .* deals|discount|50% off)\b|入手更划算|价格永降|预售：|降价 新机|大降价",
    "tech": r"\b(iphone|apple watch|electric bike|oled tv|bitcoin|ai servers|graduate speaker|ddr4|memory module|copper was king|pc enthusiasts|rog anniversary)\b|苹果手机|iphone|三星lg|小米耳机|内存暴涨|华强北|电动自行车",
    "gallery": "囧图|美女|女孩|美白|大就是美",
    "gossip": r"网红|明星|帅哥|富豪|男友|女友|暧昧|小三|恋情|约会|八卦|绯闻|社会新闻|市监局|鹅腿阿姨|滨崎步|易梦玲|胖东来|于东来|流行天后|梅西.*表情包|比尔盖茨.*(爱泼斯坦|出轨|勒索)|爱泼斯坦.*比尔盖茨|黄仁勋.*(皮夹克|满头大汗|冒汗|韩国)|\bcelebrity|influencer|dating|boyfriend|girlfriend\b",
    "strong_rumor": r"\b(leak|leaks|leaked|rumor|says preorders begin|may be announced|may begin)\b|爆料称|爆料|传闻|据称|有望|泄露",
    "weak_exposure": r"\b(reportedly)\b|曝光|曝",
    "confirmed": r"已上线|正式上线|推送上线|新增|公开|公布|发布|发售日|定档|报道|采访|主创谈及|团队表示|开发团队表示|深入.*工作室|系统版本",
    "price": r"\b(price|prices|pricing|preorders begin|stock price|pricing themselves out)\b|涨价|定价|售价|亏本|销量|首周|价格",
    "review": r"\b(metacritic|opencritic|review score|reviews? returned|scored|score)\b|m站|媒体评分|评分解禁|斩获.*分|获得.*分|高分|低分|差评|好评",
    "release": r"\b(release time|release times|full release|early access|launch|preload|go live|festival playlist|patch|update|revealed|confirmed)\b|发售|解锁|预载|上线|更新|公布|确认|定档|新增",
    "debate": r"热议|争议|走红|疯传|转发|玩家|客服|补偿|梗|整活|离谱|无厘头|投票|评论区|\bhot topic|debate|community|fans\b",
    "pc_event": r"微星|京东mall|线下观赛|外设体验|rtx\s*\d+|geforce|nvidia|amd|显卡|外设|硬件活动|\bmsi|geforce|rtx|nvidia|pc hardware\b",
    "hardware": r"\b(xbox|playstation|ps5|ps6|nintendo|switch|steam machine|steam controller|controller|console|gpu|amd gpu|nvidia|pssr|xsx|pc gaming hardware|alienware)\b|主机|掌机|手柄|xsx|ps5|ps6|switch|任天堂|索尼|微软|ns2",
    "console": "steam machine|xbox|playstation|ps5|ps6|switch|主机|掌机|手柄|索尼|微软|任天堂|ns2",
    "live": "已上线|推送上线",
}
# The rules in order, as (type, lane, reason, patterns that must match, patterns that must not).
TYPE_RULES = [
    ("off_topic_entertainment", "supplemental", "celebrity_or_gossip", ["gossip"], []),
    ("meme_gallery", "supplemental", "gallery_or_light_meme", ["gallery"], []),
    ("guide", "supplemental", "guide_or_walkthrough", ["guide"], []),
    ("general_tech", "supplemental", "generic_tech_without_game_platform", ["tech"], ["hardware"]),
    ("pc_hardware_or_event", "supplemental", "pc_hardware_event_not_core_console_or_game_news", ["pc_event"], ["console"]),
    ("deal", "supplemental", "shopping_or_discount", ["deal"], ["price"]),
    ("rumor", "main", "game_rumor_or_leak", ["strong_rumor", "game"], ["live"]),
    ("review_score", "main", "game_review_score", ["review", "game"], []),
    ("news", "main", "reported_or_live_game_news", ["confirmed", "game"], []),
    ("rumor", "main", "game_rumor_or_leak", ["weak_exposure", "game"], ["confirmed"]),
    ("platform_price", "main", "platform_or_market_price", ["price", "game"], []),
    ("hardware_platform", "main", "game_platform_hardware", ["hardware", "game"], []),
    ("news", "main", "game_release_or_update", ["release", "game"], []),
    ("news", "main", "community_debate_or_player_story", ["debate", "game"], []),
    ("deal", "supplemental", "shopping_or_discount", ["deal"], []),
    ("general_tech", "supplemental", "generic_tech", ["tech"], []),
    ("manual_review", "supplemental", "missing_editorial_focus", [], []),
]

# Editorial signals, priorities and bonuses.
CORE_SIGNALS = [
    "release date", "release window", "launch date", "gameplay trailer", "story trailer", "new trailer", "first trailer", "new gameplay", "new details", "new screenshots", "confirms", "confirmed", "announced",
    "revealed", "coming to", "will arrive", "arrives on", "early access", "full release", "demo", "dlc", "patch", "update", "remake", "remaster", "port", "review score", "metacritic", "opencritic",
    "新作", "续作", "重制", "移植", "发售日", "发售", "上线", "更新", "补丁", "试玩", "演示", "实机", "预告", "官宣", "公布", "情报", "新内容", "新玩法", "评分解禁",
]
PLATFORM_CORE_SIGNALS = [
    "release date", "release window", "launch date", "gameplay trailer", "story trailer", "new trailer", "first trailer", "new gameplay", "new screenshots", "early access", "full release", "demo", "dlc", "remake",
    "remaster", "port", "review score", "metacritic", "opencritic",
]
SENTIMENT_SIGNALS = [
    "unused", "left unused", "debate leaving", "players debate", "hot take", "old streams", "goes viral", "share of the week", "吃灰", "吐槽", "折磨", "后悔", "值不值", "怎么看", "锐评", "热议", "个人感悟", "广告太野",
    "依然震撼", "走红",
]
PLATFORM_TYPES = ("platform_price", "hardware_platform")
CORE_TYPES = ("game_detail", "game_update", "game_announcement", "release_date", "trailer", "review_score")
INTENT_PRIORITY = {"core_game_update": 4, "core_game_report": 3, "platform_business": 2, "community_or_meme": 1, "personal_or_sentiment": 0, "general": 1}
INTENT_BONUS = {"core_game_update": 12.0, "core_game_report": 8.0, "platform_business": 3.0, "community_or_meme": 2.0, "general": 0.0, "personal_or_sentiment": -10.0}

# Section keywords, in the order in which a title's sections count.
SECTIONS = {
    "sony": ["sony", "索尼", "playstation", "ps plus", "ps+", "ps5", "ps6", "ps4", "psn", "insomniac", "naughty dog", "顽皮狗", "漫威金刚狼", "wolverine"],
    "nintendo": ["nintendo", "任天堂", "switch", "switch 2", "ns2", "mario", "zelda", "pokemon", "宝可梦", "马力欧", "塞尔达"],
    "microsoft": ["microsoft", "微软", "xbox", "game pass", "bethesda", "activision", "blizzard", "forza", "halo", "gear", "战争机器"],
    "pc": ["pc", "steam", "steam deck", "epic games", "epic", "gog", "windows", "电脑", "显卡", "掌机", "rog ally"],
}
SUPPLEMENTAL = "supplemental"

# Causal markers, sensitive topics and rumor labels.
CAUSAL_ZH = "导致|因为|由于|引起|造成|所以|因此|因而|从而|致使|归因于|缘故"
CAUSAL_EN = r"(?i)\b(therefore|because|due to|caused by|caused|led to|leads to|leading to|as a result|resulting from|owing to|hence|thus|consequently|attributed to|on account of)\b"
SENSITIVE_TOPICS = {
    "price_increase": "涨价|价格上涨|价格上调|price increase|price hike|price rise|定价|售价|售价上涨|涨价了|更贵",
    "layoff": "裁员|解散|关闭工作室|关闭团队|layoff|lay off|laid off|studio closure|team disbanded|restructuring|downsiz",
    "dei": "(?<![a-zA-Z])DEI(?![a-zA-Z])|包容性|多元化|多样性|包容|diversity.*equity.*inclusion|多元化.*公平.*包容|政治正确",
    "revenue_decline": "营收下降|收入下降|亏损|利润下滑|revenue decline|revenue drop|profit decline|loss|financial trouble|财报不佳|业绩下滑",
}
RUMOR_LABELS = {"credible_rumor": "[流言][可信爆料]", "weak_rumor": "[流言][待验证]", "unverified_rumor": "[流言][未验证]"}
