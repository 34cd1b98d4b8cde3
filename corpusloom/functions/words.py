"""Fixed word lists. They decide results, so they are values, not choices."""

# fixed values: tokens that carry no search information
LOW_INFORMATION = "我 你 他 她 它 侬 的 了 啊 呀 呢 吗 吧 很 太 最 更 一下 一 下 怎么 说 讲".split()

# fixed values: question shells, deleted in this order (search normaliser)
SEARCH_SHELLS = "用上海话怎么说 上海话怎么说 上海话怎么讲 上海话里 口语里 怎么说 怎么讲 怎么表达 是什么意思 啥意思 这个词 这个 请问 麻烦问下 麻烦 想问下 想问 请看 到底 功能 说法 表达".split()

# fixed values: question shells, deleted in this order (shared normaliser)
SHARED_SHELLS = "用上海话怎么说 上海话怎么说 上海话怎么讲 上海话里 怎么说 怎么讲 怎么表达 是什么意思 啥意思 这个词 这个 请问 麻烦问下 麻烦".split()

# fixed values: suffix shells, tried in this order (rule normaliser)
RULE_SUFFIXES = "怎么说 怎么讲 怎么表达 是什么意思 啥意思 用上海话怎么说 用上海话怎么讲 上海话里怎么说 上海话怎么说 上海话怎么讲".split()

# fixed values: words that are always lexical items
SPECIAL_WORDS = "没用 有意思 难受 开心 伤心 高兴".split()

# fixed values: stop words of keyword cleaning
RULE_STOPWORDS = "我 你 他 她 它 我们 你们 他们 给 把 被 对 向 跟 在 从 和 啊 呢 吗 吧 呀 的 地 得".split()

# fixed values: stop words of keyword windows
WINDOW_STOPWORDS = "我 你 他 她 它 我们 你们 他们 这个 那个 一下 请问 麻烦 帮我 上海话 怎么 怎样 表达".split()

# fixed values: query prefixes, query suffixes, removable tokens (in this order), pronouns
PREFIXES = "我 请 帮我 麻烦 想问下 想问".split()
SUFFIXES = "了 啊 呀 呢 嘛 吧 吗".split()
REMOVABLE = "我 你 他 她 它 我们 你们 他们 她们 它们 把 给 跟 向 对 用 到底 一下 讲 说 这个 那个 这些 那些 是不是 这样 那样 应该 可以 能不能 要不要 想 要".split()
PRONOUNS = "你 他 她 它".split()

# fixed values: particles that exact lookup also tries without
LOOKUP_PARTICLES = "了 吗 呢 啊 呀".split()

# fixed values: Mandarin -> dialect, tried in this order
DIALECT_PAIRS = [
    ("不", "勿"), ("什么", "啥"), ("怎么", "哪能"), ("这里", "迭搭"), ("那里", "伊面"), ("这个", "迭个"), ("那个", "伊个"), ("这样", "迭能"), ("那样", "伊能"),
    ("没有", "呒没"), ("不要", "覅"), ("不用", "覅"), ("没有", "呒"), ("很", "邪气"), ("非常", "邪气"), ("太", "忒"), ("漂亮", "趣"), ("好看", "趣"), ("舒服", "适意"),
    ("累", "衰"), ("喝", "吃"), ("说话", "讲闲话"), ("聊天", "讲张"), ("吵架", "相骂"), ("打架", "相打"), ("睡觉", "困觉"), ("起床", "起来"), ("回家", "转去"), ("回去", "转去"),
    ("上午", "上半日"), ("下午", "下半日"), ("今天", "今朝"), ("明天", "明朝"), ("后天", "后日"), ("昨天", "昨日"), ("前天", "前日"), ("早上", "早浪向"), ("晚上", "夜头"),
    ("中午", "中浪向"), ("时候", "辰光"), ("刚才", "刚刚"), ("一直", "一径"), ("经常", "常桩"), ("偶尔", "难得"), ("全部", "侪"), ("都", "侪"), ("不是", "勿是"),
    ("不行", "勿来"), ("不会", "勿会"), ("不知道", "勿晓得"), ("明白", "晓得"), ("知道", "晓得"), ("告诉", "讲拨"), ("给", "拨"), ("说", "讲"),
]
