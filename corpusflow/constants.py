"""Fixed values.

Everything in this module is a FIXED VALUE: texts, lists and limits whose exact
content decides whether our output equals the output of the tools we reproduce
(prompt texts, failure markers, truncation markers, separators, encodings).
They are stated plainly and in their natural order; do not edit them to make
output "look better" -- the rendered requests and samples would change.
"""

from __future__ import annotations

# --- FIXED VALUES: characters --------------------------------------------------

# The 29 characters for which Python's ``str.isspace()`` is true, in code-point
# order.  ``str.strip()`` removes exactly these; Spark's plain ``trim`` only
# removes U+0020, so every strip goes through ``trim(c, WS)``.
WS = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020"
    "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- FIXED VALUES: corpus discovery and decoding --------------------------------

ALLOWED_EXTENSIONS = [".txt", ".md", ".csv", ".xlsx", ".xls", ".pdf", ".docx", ".doc"]
NOVEL_EXTENSIONS = [".txt", ".text"]
# Decoding order tried per file; the first that decodes the whole file wins.
ENCODINGS = ["utf-8", "utf-8-sig", "gbk", "gb2312", "gb18030", "big5", "latin1"]
# Separators tried for delimited files, in order.
CSV_SEPARATORS = [",", ";", "\t", "|"]

# --- FIXED VALUES: segmentation ---------------------------------------------------

DEFAULT_MIN_LEN = 200
DEFAULT_MAX_LEN = 800
PARAGRAPH_DELIM = "\n{2,}"          # blank-line paragraphs (novel segmentation)
MARKDOWN_DELIM = "\n\n"             # Markdown blocks
SEGMENT_JOINER = "\n\n"
# Continuation split: punctuation searched in this order around the middle.
SPLIT_MARKS = ["。", "！", "？", "\n"]
CONTINUATION_MIN_SEGMENT = 100      # shorter segments give no continuation sample
CONTINUATION_MIN_PART = 50          # either half shorter than this -> dropped
CONTINUATION_DISPLAY = 200          # first part shown to the user, then "..."

# --- FIXED VALUES: request rendering and limits -------------------------------------

PROCESSOR_SYSTEM = "你是一个专业的文本处理助手，请根据用户的要求处理文本内容。"
BUILDER_SYSTEM = "你是一个专业的文本处理助手，请根据用户的要求处理文本内容。请保持回复简洁明了。"
USER_TEMPLATE_HEAD = "请根据以下要求处理文本：\n\n要求："
USER_TEMPLATE_MID = "\n\n文本内容："
PROCESSOR_INPUT_CAP = 10000
PROCESSOR_TRUNCATION_MARKER = "...[文本过长，已截断]"
BUILDER_INPUT_CAP = 8000
BUILDER_TRUNCATION_MARKER = "...[文本过长已截断]"
BUILDER_STOP = ["<|im_end|>", "<|endoftext|>", "\n\n\n", "<|im_start|>", "\n\n"]
MAX_TOKENS_CEILING = 4096
MAX_TOKENS_CAP = 2048
MAX_TOKENS_FLOOR = 256
DEFAULT_BATCH_SIZE = 10
DEFAULT_CONCURRENCY = 3

# --- FIXED VALUES: outcome markers ------------------------------------------------

FAILED = "处理失败"
FAILED_PREFIX = "处理失败: "
FAILED_CONNECTION = "处理失败: 连接错误 - {err} (已重试{n}次)"
FAILED_TIMEOUT = "处理失败: 超时错误 - {err} (已重试{n}次)"
FAILED_RATE_LIMIT = "处理失败: 速率限制 - {err} (已重试{n}次)"
QUALITY_ERROR_PATTERN = "处理失败|错误|失败"
ITEM_RETRIES = 3

# --- FIXED VALUES: prompt-task catalog -------------------------------------------

DEFAULT_TASKS = {
    "文本摘要": "请为以下文本生成一个简洁的摘要，突出主要内容和关键信息。",
    "关键词提取": "请从以下文本中提取5-10个关键词，用逗号分隔。",
    "情感分析": "请分析以下文本的情感倾向，回答积极、消极或中性，并简要说明理由。",
    "文本分类": "请对以下文本进行分类，并说明分类理由。",
    "问题生成": "请根据以下文本内容生成3-5个相关问题。",
    "文本翻译": "请将以下文本翻译成英文。",
    "内容扩展": "请基于以下文本内容进行扩展，增加更多细节和信息。",
    "格式化": "请将以下文本进行格式化整理，使其更加规范和易读。",
}

# Saved tasks shipped next to the tool; they overlay DEFAULT_TASKS by name.
SHIPPED_TASKS = {
    "转换方言文本": "将输入的内容进行转换，要求将方言文本转换成普通话文本，需要符合普通话的文本类型，添加合适的标点符号；生成普通话文本的语序，意思和字数与方言文本一致；不要输出无关的注释和说明",
    "中文翻译": "将以下文本准确翻译为中文，要求：  \n1. **语义一致**：完全保留原文含义，不增删关键信息  \n2. **重复字符处理**：对连续重复的字符（如\"哈哈哈\"）采用符合中文表达习惯的转译（如\"笑个不停\"）  \n3. **语言规范**：  \n   - 使用书面语语法  \n   - 禁止添加解释性注释  \n   - 禁用机器翻译常见的生硬句式  \n4. **输出限制**：仅呈现最终译文，不含翻译说明或额外换行",
    "文本添加标点": "给输入的内容添加合适的标点符号，不要修改原来的文本内容，不要输出无关的注释和说明",
    "提示词优化": "### AI提示词优化助手\n**角色**：你是一位专业的提示词工程师，擅长将模糊需求转化为精准、可执行的AI指令。  \n**任务**：优化用户输入的提示词，提升其明确性、完整性和输出质量。  \n**优化原则**：  \n1. **明确意图**：识别用户核心目标，补充必要背景（如受众、场景、格式要求）  \n2. **结构化指令**：将复杂任务拆解为步骤，用分隔符（如```）划分逻辑段落  \n3. **预防歧义**：替换模糊词汇（如“好”、“专业”），量化标准（如“列出3个要点”）  \n4. **补充约束**：添加限制条件（如长度、禁用术语、语气风格）  \n5. **增强可操作性**：为AI提供思考框架（如：“先解释概念，再对比优缺点”）  \n\n**优化流程**：  \n1. 解析原始提示的潜在需求  \n2. 按优化原则改写提示词  \n3. 输出格式，只需要输出优化后的提示词内容，不要输出注释说明等内容：  \n   [优化后提示词的完整内容]  \n\n\n**示例原始输入**：\"帮我写一篇人工智能的文章\"  \n撰写一篇面向零基础读者的AI科普文章，要求：  \n1. 主题：用生活化案例解释人工智能是什么  \n2. 结构：  \n   - 开头用1句话定义AI  \n   - 用「智能音箱」为例说明工作原理（占全文30%）  \n   - 列举2个日常应用场景  \n   - 结尾用未来展望收尾  \n3. 语言：口语化，禁用技术术语  \n4. 篇幅：严格500字内",
}

# --- FIXED VALUES: dataset tasks --------------------------------------------------

TASK_WRITING = "写作"
TASK_CONTINUATION = "续写"
TASK_REVISION = "修改"
DATASET_TASKS = [TASK_WRITING, TASK_CONTINUATION, TASK_REVISION]

# Reverse-prompt catalog type of each dataset task.
REVERSE_TYPE = {
    TASK_WRITING: "小说写作",
    TASK_CONTINUATION: "小说续写",
    TASK_REVISION: "小说修改",
}

PREDEFINED_REVERSE_PROMPTS = {
    "小说写作": {
        "基础创作": "请根据以下小说内容，分析其主题、风格、情节特点和写作手法，然后生成一个自然的用户创作请求。用户希望创作具有相似特色的小说片段，请模拟用户可能提出的具体写作需求。",
        "风格模仿": "请仔细分析以下小说片段的写作风格（如叙述视角、语言特色、节奏感、修辞手法等），然后生成一个用户请求，询问如何写出具有相同风格特点的内容。请确保生成的请求具体且实用。",
        "情节构思": "请根据以下小说内容，识别其情节类型、冲突设置、故事结构等特点，然后生成一个用户关于情节创作的具体询问，包括场景设定、人物关系、冲突发展等方面。",
        "人物塑造": "请分析以下小说中的人物刻画手法（如外貌描写、心理描写、对话特点、行为特征等），生成一个用户询问如何塑造类似人物的详细请求。",
        "场景描写": "请分析以下小说中的场景描写技巧（如环境渲染、氛围营造、细节刻画等），生成一个用户询问如何描写类似场景的请求。",
        "对话写作": "请分析以下小说中的对话写作特点（如语言风格、人物性格体现、推动情节等），生成一个用户询问如何写好对话的请求。",
        "情感表达": "请分析以下小说中的情感表达方式（如内心独白、情感渲染、情绪变化等），生成一个用户询问如何表达类似情感的请求。",
    },
    "小说续写": {
        "情节延续": "请根据以下小说前半部分的内容和后半部分的发展，分析情节的逻辑连接点、转折方式和发展脉络，然后生成一个用户续写请求，要求从前半部分自然过渡到后半部分。",
        "风格保持": "请分析以下小说的写作风格、叙述特点和语言特色，生成一个用户请求，询问如何在续写中保持原文的风格一致性，包括语调、节奏、用词习惯等。",
        "情节发展": "请根据小说前文的铺垫和后文的结果，推测中间的情节发展逻辑，生成一个用户询问如何合理发展情节的续写请求。",
        "人物发展": "请分析小说中人物在前后文中的变化和成长，生成一个用户询问如何在续写中展现人物发展的请求。",
        "冲突推进": "请分析小说中冲突的发展脉络，生成一个用户询问如何在续写中推进冲突、制造悬念的请求。",
        "氛围营造": "请分析小说的整体氛围和情绪基调，生成一个用户询问如何在续写中保持或发展这种氛围的请求。",
    },
    "小说修改": {
        "文本润色": "请对比修改前后的文本，分析具体的改进方向（如语言流畅度、表达准确性、文字优美度等），然后生成一个用户关于文本润色的具体请求。",
        "风格调整": "请分析文本修改的风格变化方向（如从平实到华丽、从严肃到轻松等），生成一个用户询问如何调整写作风格的详细请求。",
        "内容完善": "请根据修改后内容的改进点（如增加细节、完善逻辑、丰富情感等），推测用户想要完善的具体方面，生成相应的修改请求。",
        "结构优化": "请分析文本在结构方面的调整（如段落重组、逻辑梳理、层次分明等），生成一个用户询问如何优化文本结构的请求。",
        "语言精炼": "请对比修改前后的语言表达，分析精炼和优化的方向，生成一个用户询问如何让语言更加精炼有力的请求。",
        "情感强化": "请分析修改后文本在情感表达方面的增强，生成一个用户询问如何强化情感表达效果的请求。",
        "逻辑完善": "请分析修改后文本在逻辑方面的完善，生成一个用户询问如何让文本逻辑更加清晰严密的请求。",
    },
}

# Default system prompt of each dataset task (used when the given one is blank).
SYSTEM_DEFAULT = {
    TASK_CONTINUATION: "你是一名专业的小说创作助手，能够根据用户提供的小说上文，自然地续写接下来的情节。",
    TASK_WRITING: "你是一名专业的小说创作助手，擅长根据用户的指令生成生动、有趣的故事片段。",
    TASK_REVISION: "你是一名专业的编辑助手，擅长根据用户的要求对文字进行润色、修改和优化。",
}

CONTINUATION_TEMPLATE = "请续写以下段落："
CONTINUATION_EXTRA_LABEL = "续写要求："
OPEN_QUOTE = "『"
CLOSE_QUOTE = "』"
WRITING_FALLBACK = "请创作一段小说内容。"
REVISION_FALLBACK = "请优化文笔，使其更流畅、生动且符合中文写作习惯。"
REVISION_HEAD = "请根据以下要求优化这段文本：\n\n要求："
REVISION_MID = "\n\n文本：\n"

# Model-backed user prompts (writing and revision samples).
WRITING_REVERSE_DEFAULT = "请根据以下生成的小说内容，反推出一个合理的创作要求或写作指令，作为用户的提问。要求简洁明了，符合创作逻辑。格式如：'写一个[题材]小说的[场景]，[具体要求]。'"
WRITING_TEXT_HEAD = "生成的内容："
REVISION_REVERSE_DEFAULT = "请根据原文和修改后的内容，推断出用户可能提出的修改要求。要求简洁明了，具体可操作。"
REVISION_TEXT_ORIGINAL = "原文："
REVISION_TEXT_MODIFIED = "\n\n修改后内容："
EXTRA_LABEL = "\n\n用户额外要求："
FOCUS_LABEL = "\n\n关注点："
FOCUS_CLAUSE = "\n\n请特别关注以下方面："
SIMPLIFY_PROMPT = "请将以下文本稍微简化，降低文学性，模拟修改前的原始状态。保持主要内容不变，但表达更朴素一些。"

# Prompt-only (two-role) messages.
PROMPT_ONLY_SYSTEM = "你是一名专业的小说创作助手。"
PROMPT_ONLY_CONTINUATION_HEAD = "请续写以下段落：\n\n"
PROMPT_ONLY_WRITING_FALLBACK = "请根据给定题材与风格创作一段小说片段（300-500字）。"

# Default user contents and default instructions per task.
DEFAULT_USER_CONTENT = {
    TASK_WRITING: "请创作一段小说内容。",
    TASK_CONTINUATION: "请续写以下内容。",
    TASK_REVISION: "请优化以下文本内容。",
}
DEFAULT_INSTRUCTION = {
    TASK_WRITING: "请根据参考文本和创作要求，生成一段高质量的小说内容。保持文风一致，情节合理，字数控制在300-500字。",
    TASK_CONTINUATION: "请根据上文内容，自然地续写接下来的情节。保持原有的写作风格、人物性格和故事节奏。续写内容应该在300-500字之间，情节要有逻辑性和连贯性。",
    TASK_REVISION: "请对原文进行润色和优化，提升语言表达的流畅性、准确性和文学性。保持原意不变，但让表达更加生动、自然。",
}

# Excerpt lengths used by previews and listings.
EXCERPT_PREVIEW = 150
EXCERPT_RESULT = 50
EXCERPT_LISTING = 80
EXCERPT_RAW = 100
