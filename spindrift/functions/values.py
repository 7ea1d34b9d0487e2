"""Fixed values that results depend on: vocabularies, thresholds, patterns and weights."""

# Types of a channel by its share of short videos, and won per view.
SHORT, LONG, MIXED, NONE = "숏폼", "롱폼", "혼합", ""
SHORT_SHARE, LONG_SHARE = 0.8, 0.2
RATE = {"숏폼": 0.15, "혼합": 0.8, "롱폼": 2.5, "": 0.8}

# Grades by daily views.
GRADES = [("S", 5_000_000), ("A", 1_000_000), ("B", 300_000), ("C", 100_000)]

# Videos that rise fast, by daily views, or by all views where no daily views exist.
ROCKET_DAILY, ROCKET_TOTAL = 100_000, 500_000

# A short lasts 180 s at most; a probed trending video 190 s, 60 s where the probe is silent.
SHORT_SECONDS, TRENDING_SECONDS, TRENDING_FALLBACK = 180, 190, 60

# Categories, and the first matching pattern of a genre.
CATEGORIES = [
    "영화·드라마 요약", "연예 이슈", "지식·역사·교양", "스포츠", "정치·시사",
    "국뽕·해외반응", "방송·예능", "게임", "유머·밈·바이럴", "동물·펫",
    "음악", "썰·사연·애니툰", "푸드", "랭킹·순위 정보", "기타",
]
NO_GENRE = ["기타/혼합", "종합/기타"]
CATEGORY_PATTERNS = [
    ("게임", r"(?i)게임|로블록스|LOL|롤 |e스포츠|이스포츠|매드무비|버츄얼"),
    ("국뽕·해외반응", r"국뽕|해외\s?반응|해외\s?이슈|해외\s?바이럴"),
    ("스포츠", r"스포츠|축구|격투|무술|야구|중계|하이라이트"),
    ("영화·드라마 요약", r"영화|드라마"),
    ("방송·예능", r"방송|예능|성우|엔터"),
    ("연예 이슈", r"연예|아이돌|트로트"),
    ("음악", r"음악|감성"),
    ("동물·펫", r"동물|반려|펫|힐링"),
    ("유머·밈·바이럴", r"유머|밈|짜집기|짜깁기|바이럴|공감"),
    ("썰·사연·애니툰", r"썰|사연|애니|툰|서브컬처"),
    ("랭킹·순위 정보", r"랭킹|순위|인포그래픽|모음"),
    ("정치·시사", r"정치|시사|사회|뉴스|국방|사건"),
    ("지식·역사·교양", r"역사|지식|교양|인문|상식|미스터리|교육|어학|건강|운세|재테크|부동산|경제|정보|산업|실화|스토리텔링"),
    ("푸드", r"푸드|음식|먹방|요리|레시피"),
]

# Statuses an administrator gives; no status counts as waiting.
APPROVED, EXCLUDED, WAITING = "승인", "제외", "대기"
OTHER_CATEGORY = "기타"

# Weights of a candidate's scores by objective; context_indep is 10 - context_dep.
OBJECTIVES = {
    "views": {"hook": 0.30, "novelty": 0.20, "emotion": 0.15, "density": 0.10, "standalone": 0.10, "proof": 0.05, "duration_fit": 0.05, "context_indep": 0.05},
    "sales": {"hook": 0.15, "proof": 0.25, "standalone": 0.15, "density": 0.15, "emotion": 0.10, "novelty": 0.05, "duration_fit": 0.05, "context_indep": 0.10},
    "edu": {"hook": 0.15, "density": 0.25, "proof": 0.20, "standalone": 0.15, "novelty": 0.10, "duration_fit": 0.05, "context_indep": 0.10},
}

# Words that mark an exciting line, and subjects whose rights need care.
HOT_WORDS = ["최초", "충격", "드디어", "놀라", "기적", "포착", "성공", "위기", "탄생", "발견", "결정적", "믿을 수 없", "!"]
RISKY_RIGHTS = ["스포츠", "중계", "경기", "격투", "축구", "야구", "농구", "배구", "골프", "UFC", "GLORY", "KBO", "올림픽", "방송", "예능", "드라마", "영화", "애니메이션", "음원", "노래", "뮤직", "콘서트", "공연", "가수", "아이돌"]
RIGHTS_CAREFUL = "주의가 필요한 소재입니다 (중계·방송·영화·음원은 사용권 문제가 잦습니다)"
RIGHTS_CHECK = "사용권 확인이 필요합니다"

# Hosts of videos.
VIDEO_SITES = [
    "douyin.com", "iesdouyin.com", "tiktok.com", "kuaishou.com", "chenzhongtech.com", "haokan.baidu.com", "quanmin.baidu.com",
    "mbd.baidu.com/newspage/data/videolanding", "bilibili.com", "b23.tv", "iqiyi.com", "v.qq.com", "youku.com", "mgtv.com",
    "ixigua.com", "xiaohongshu.com", "xhslink.com", "weibo.com", "weibo.cn", "56.com", "tv.sohu.com", "pearvideo.com",
    "meipai.com", "youtube.com", "youtu.be", "dailymotion.com", "vimeo.com", "reddit.com", "redd.it", "instagram.com",
]

# A platform's name by the first mark found in a site's name or address.
PLATFORMS = [
    ("더우인", ["抖音", "douyin"]), ("바이두 영상", ["度小视", "quanmin.baidu"]), ("하오칸 영상", ["好看", "haokan.baidu"]), ("웨이보", ["微博", "weibo"]),
    ("콰이쇼우", ["快手", "kuaishou"]), ("비리비리", ["哔哩", "bilibili"]), ("시과 영상", ["西瓜", "ixigua"]), ("샤오홍슈", ["小红书", "xiaohongshu"]),
    ("텐센트 영상", ["腾讯", "v.qq.com"]), ("유큐", ["优酷", "youku"]), ("유튜브", ["youtube", "youtu.be"]), ("바이두", ["baidu"]),
]
NO_PLATFORM = "출처 보기"

# Addresses of lists rather than of single videos.
TIKTOK = r"(?i)tiktok\.com"
TIKTOK_VIDEO = r"(?i)tiktok\.com/@[^/]+/video/\d+|//(vm|vt)\.tiktok\.com/[A-Za-z0-9]+"
LISTINGS = r"(?i)instagram\.com/(popular|explore|directory|topics)/|youtube\.com/(hashtag/|results|channel/|source/)|reddit\.com/r/[A-Za-z0-9_]+/?$"

# An 11-character video id in an address.
VIDEO_ID = r"(?:youtube\.com/(?:watch\?[^#]*v=|shorts/|embed/|live/)|youtu\.be/)([A-Za-z0-9_-]{11})"

# Medals of the first places, and the word for a place.
MEDALS, PLACE = ["🥇", "🥈", "🥉"], "위"

# Forms of a video id, of an address and of a preview picture's address.
ID_FORM, ADDRESS_FORM = r"^[A-Za-z0-9_-]{11}$", r"^https?://.+\..+"
PICTURE_FORM = r"^https://i\.ytimg\.com/vi/[A-Za-z0-9_-]{6,20}/[A-Za-z0-9_]{1,20}\.jpg$"

# A project's status when a job of this type fails for good.
FAILED_STATUS = {"transcribe": "failed_transcribe", "analyze": "failed_analyze", "render": "failed_render", "desilence": "failed_desilence", "wmremove": "failed_wm"}
FAILED_OTHER = "failed_probe"
