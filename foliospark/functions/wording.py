"""Words, numbers and patterns that appear in results."""

# Results must show exactly these.
UNKNOWN_LAYER = "未知层级"
UNNAMED_BOOK, UNNAMED_RESOURCE, UNNAMED_HOTSPOT = "未命名教材", "未命名课件", "未命名热点新闻"
BOOK_HEADING = "# 【教材】《{0}》- {1} - {2}"
RESOURCE_HEADING = "# 【优质资源】{0} - 第 {1} 页"
GOALS_HEADING = "# 【课程标准】教学大纲核心目标"
POINTS_HEADING = "# 【课程标准】大纲知识点详述"
HOTSPOT_HEADING = "# 【时事热点】新闻素材：{0}"
OTHER_HEADING = "# 【{0}】补充知识片段"
RULE = "---"
SKIPPED_KEYS = ("id", "_id", "created_at", "layer", "source_type", "metadata", "hotspot_index")
LEAF_LONGER_THAN, CHUNK_LONGER_THAN = 5, 10

UNNAMED_STAGE, GAME_LOADED = "未命名环节", "[🎮 互动游戏已载入]"
GAME_KEY = '"game_type"'
EVIDENCE_SOURCE, EVIDENCE_LABEL = "云端知识库", "【来源: {0}】"
OUTSIDE_LABEL, CLOUD_LABEL = "【外部资料片段】", "【云端图谱增强知识】"

SHEETS, IMAGES, VIDEOS = ("xlsx", "xls"), ("png", "jpg", "jpeg", "bmp", "webp"), ("mp4", "avi", "mov", "mkv")
DOCUMENTS = ("pdf", "docx", "pptx")
MAX_CHARS = 80_000
CUT_NOTICE = "\n\n[⚠️ 系统提示：因上传资料过长，为保证AI生成质量，后续内容已被智能截断。建议分章节上传。]"
NOTHING_READ = "[提取内容为空或系统缺少对应解码器]"
SHEET_CAPTION, OCR_CAPTION, SPEECH_CAPTION = "[📊 表格：{0}]", "[🖼️ 图片 OCR 提取内容]", "[🎬 视频语音转写内容]"
OCR_FAILED, SPEECH_FAILED = "[🖼️ 图片解析失败: {0}]", "[🎬 视频解析失败: {0}]"
TABLE_CAPTION, PLAIN_TABLE_CAPTION = "[📊 提取到精美表格数据]", "[📊 表格数据]"

CANVAS, CANVAS_INCHES = (1280, 720), (13.333, 7.5)
DECK_TITLE = "项目 {0} 演示文稿"
UNNAMED_PAGE, GAME_LINK = "未命名页面", "🎮 点击启动课堂互动小游戏"
PLACEHOLDER = "/*INJECT_DATA*/"
DEFAULT_GAME = "memory_match"

LESSON_TITLE, UNNAMED_COURSE, ANYONE = "教 学 详 案", "未命名课程", "通用"
DEFAULT_MINUTES, DEFAULT_METHODS = 45, ("讲授法", "案例分析法")
METHODS_JOIN, POINTS_JOIN, NO_POINTS = "、", "；", "详见教学过程"
DIFFICULT, KEY, PLAIN = "🔥[难点] ", "⭐[重点] ", "🔸 "
NO_PAGES = "未能从大纲中提取出有效页面"
CELL_FILL = "EFEFEF"
HOMEWORK = "结合本节课重点，完成课后相关练习，并进行复盘总结。"
INTERACTION = "讲授与演示"
KEPT_FILES, KEPT_HOURS, TOKEN_MINUTES = ("template.pptx", ".gitkeep"), 24, 1440
# Element: font size, bold, colour, x, y, width, height.
HEADING_LOOK = (40, True, "#1A202C", 80, 60, 1120, 80)
BODY_LOOK, BODY_WIDTH_BESIDE_IMAGE = (22, False, "#4A5568", 80, 160, 1120, 450), 600
IMAGE_LOOK = (None, False, None, 750, 160, 450, 450)
GAME_LOOK = (18, True, "#0070C0", 80, 620, 400, 50)
# What a renderer assumes: width, height, text and link size, link colour, line spacing, font; site of links.
PLAIN_BOX, TEXT_SIZE, LINK_SIZE, LINK_COLOR, LINE_SPACING, FONT = (800, 100), 20, 18, "#0070C0", 1.3, "Microsoft YaHei"
SITE = "http://127.0.0.1:8000"
NUMBER_LOOK = (14, False, "#A0AEC0", 1150, 680, 100, 30)

MINUTES = "{0} 分钟"
INTENT = "【互动形式】\n{0}\n\n【时间安排】\n{1} 分钟"
GOALS = "教学目标：\n{0}\n重点：{1}\n难点：{2}"
# Labels of the lesson tables: table, row, column, text.
LESSON_LABELS = (
    (1, 0, 0, "教学基本信息"),
    (1, 1, 0, "课题"),
    (1, 2, 0, "授课对象"),
    (1, 2, 2, "课程时长"),
    (1, 3, 0, "教学方法"),
    (2, 0, 0, "教学目标及教学重点、难点"),
    (3, 0, 0, "教学过程与课堂活动设计"),
    (3, 1, 0, "教学环节"),
    (3, 1, 1, "主要教学活动与内容"),
    (3, 1, 2, "意图及互动形式"),
    (4, 0, 0, "课后作业及拓展延伸"),
)

# Patterns: a game inside a description, and an object inside a reply.
GAME_SPAN = r'\{[\s\S]*?"game_type"[\s\S]*?\}'
OBJECT_SPAN = r"(?s)\{.*\}"
FENCE = "`json"
# End of the fixed values.
