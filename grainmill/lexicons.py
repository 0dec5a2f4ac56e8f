"""Word lists, field names and thresholds. All operators take them as arguments; these are the defaults.

The values are fixed: results must equal those of the data and models they were made for.
"""

from __future__ import annotations

from dataclasses import dataclass

# Names in the analysis payload.
TOP_KEY = "palmistry_analysis"
REQUIRED_LINES = ("生命线", "智慧线", "感情线", "事业线")
OPTIONAL_LINES = ("婚姻线",)
LINE_FIELDS = ("位置判断", "清晰度", "长度", "深浅", "特殊结构", "日系分类", "图像依据")
EVIDENCE_FIELD = "图像依据"
REPORT_FIELDS = ("traditional_report", "japanese_report", "mystic_energy_report", "medical_report", "blessing")
UNKNOWN_VALUE = "难以判断"

# Keywords of a report's sections, in their order.
SECTIONS = (
    ("整体印象",),
    ("生命线",),
    ("智慧线",),
    ("感情线",),
    ("事业线", "事业线与发展节奏"),
    ("整体能量", "近期运势", "整体能量与近期运势"),
    ("现实建议", "温和提醒", "现实建议与温和提醒"),
    ("总结祝福", "总结", "祝福"),
)
LINE_KEYWORDS = {"生命线": ("生命线",), "智慧线": ("智慧线",), "感情线": ("感情线",), "事业线": ("事业线", "事业线与发展节奏")}
DISPLAY_HEADINGS = ("整体印象", "生命线", "智慧线", "感情线", "事业线与发展节奏", "事业线", "整体能量与近期运势", "现实建议与温和提醒", "总结祝福")
DISPLAY_CORE = ("整体印象", "生命线", "智慧线", "感情线", "事业线", "事业线与发展节奏")
DISPLAY_ENERGY = ("整体能量与近期运势",)

# Five different lists of uncertain wording. They are not interchangeable.
GATE_MARKERS = ("难以判断", "无法", "模糊", "不可见", "不清晰", "噪点", "遮挡")
CHALLENGE_TERMS = ("难以判断", "无法", "不可见", "不可辨", "模糊", "不清晰", "噪点", "遮挡", "可见信息有限", "无法准确判断")
UNCERTAIN_TERMS = ("难以判断", "图像不够清晰", "可见信息有限", "看不清", "信息有限", "无法准确判断", "手掌图像模糊", "模糊", "不清晰", "噪点", "遮挡")
CAUTIOUS_TERMS = (*UNCERTAIN_TERMS, "谨慎分析", "保守观察", "仅作保守观察", "建议结合更清晰照片", "建议在自然光下重拍")
RUNTIME_MARKERS = ("难以判断", "无法", "不可见", "不可辨", "模糊", "不清晰", "噪点", "遮挡", "低", "极低", "较低", "不足", "缺失")
RETAKE_TERMS = ("建议重拍", "重新拍摄", "重新拍一张", "重拍一张", "更清晰的掌心照片")

# Details, evidence and assertive wording in reports.
DETAIL_TERMS = ("岛纹", "断裂", "分叉", "双重", "二股", "三股", "锁链", "链状", "羽毛状", "十字", "佛眼", "神秘十字", "三奇纹")
EVIDENCE_TERMS = (
    *("清晰", "模糊", "较长", "长", "较短", "短", "较深", "深", "较浅", "浅", "分叉", "断裂", "岛纹", "双重", "二股", "三股", "链状"),
    *("羽毛状", "上扬", "下垂", "平直", "弧形", "重合", "同源", "断续", "现实型", "感性型", "直觉型", "标准型"),
    *("木星丘", "月丘", "金星丘", "水星丘", "太阳丘"),
)
ASSERTIVE_PATTERNS = (
    "(明显|清晰|分明).{0,4}(断裂|分叉|岛纹|双重|二股|三股|十字|贯穿)",
    "(深|较深|很深).{0,2}(长|较长|很长)",
    "(线条|走势).{0,4}(清晰|深刻|明显)",
    "(贯穿掌心|清晰可见|深刻有力|深长有力)",
)

# Safe and banned wording, of reports and of structured payloads.
REPORT_SAFE = ("手相仅供参考", "仅供参考", "请以生活实际为准", "请以现实实际为准", "真正重要的是当下选择和行动")
REPORT_BANNED = ("保证", "绝对", "包治", "治愈", "确诊", "注定", "百分之百")
PAYLOAD_SAFE = ("仅供参考", "请以生活实际为准", "请以现实实际为准", "不构成诊断", "不可替代医学")
PAYLOAD_BANNED = ("保证", "绝对", "确诊", "治愈", "包治")

# Patterns of the generation filter.
POSITIVE_BASIS = ("可见", "观察到", "清晰", "明显", "连续", "起始点", "主体", "走向", "延伸", "弧形", "横向", "纵向", "主纹路")
HARD_UNCERTAIN = (
    *("输入图片未提供", "图像未提供", "未观察到明显", "未见明显", "无法", "不可见", "不可辨识", "无法辨认"),
    *("难以判断", "难以准确判断", "无法清晰", "细节缺失", "完全不可见"),
)
REPORT_UNCERTAIN = ("图像质量", "难以", "无法", "模糊", "不可辨识", "不清晰")

# The three decisions, their labels, and what a decision alone says of an image.
DECISIONS = ("continue", "cautious", "retake")
DECISION_LABELS = {"continue": "继续分析", "cautious": "谨慎分析", "retake": "建议重拍"}
DECISION_METADATA = {"continue": ("清晰", 4, "无"), "cautious": ("一般", 3, "轻微"), "retake": ("模糊", 1, "明显")}
SEVERE_REASONS = ("below_quality_floor", "below_sharpness_floor", "too_dark", "too_bright")
JUDGE_DECISIONS = ("accept", "accept_cautious", "reject")
JUDGE_SCORES = ("visual_grounding", "uncertainty_honesty", "line_consistency", "schema_quality")
#: Reward by expected (rows) and predicted (columns) decision.
GATE_REWARDS = {"continue": (1.0, 0.6, 0.0), "cautious": (0.2, 1.0, 0.6), "retake": (0.0, 0.8, 1.0)}

# Markers of the chat formats.
IGNORE_INDEX = -100
IMAGE_TAG, VIDEO_TAG = "<image>", "<video>"
IMAGE_TOKENS = "<|vision_start|><|image_pad|><|vision_end|>"
VIDEO_TOKENS = "<|vision_start|><|video_pad|><|vision_end|>"
SYSTEM_MESSAGE = "You are a helpful assistant."
ROLES = {"human": "user", "gpt": "assistant"}
CLUSTER_PATTERN = r"^(.+)\.rf\.[^.]+$"


@dataclass(frozen=True)
class CurationLimits:
    max_per_cluster: int = 2
    quality_quantile: float = 0.45
    sharpness_quantile: float = 0.40
    secondary_ratio: float = 0.88
    min_brightness: float = 45.0
    max_brightness: float = 215.0


@dataclass(frozen=True)
class GateThresholds:
    least: float = 0.55
    least_continue: float = 0.65
    least_retake: float = 0.65
    margin: float = 0.10


@dataclass(frozen=True)
class JudgeLimits:
    average: float = 3.5
    grounding: float = 3.0
    honesty: float = 3.0
    allow_cautious: bool = True
