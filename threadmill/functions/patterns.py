"""Patterns and word lists. They are fixed values: results are only right if they say exactly this."""

KEYWORDS = [
    "docker", "kubernetes", "k8s", "terraform", "ansible", "helm", "aws", "gcp", "vercel", "netlify", "nginx", "postgres", "postgresql",
    "mysql", "sqlite", "redis", "mongodb", "graphql", "rest", "grpc", "webhook", "oauth", "jwt", "auth", "migration", "cron", "launchd",
    "systemd", "python", "typescript", "javascript", "react", "nextjs", "node", "rust", "go", "tailwind", "css", "eslint", "prettier",
    "pytest", "jest", "playwright", "puppeteer", "threejs", "webgl", "shader", "glsl", "r3f", "framer", "gsap", "animation", "linear",
    "telegram", "granola", "affinity", "slack", "github", "git", "seo", "geo", "palette", "dashboard", "chart", "dataviz", "prisma",
    "drizzle", "supabase", "firebase", "sentry", "datadog", "grafana", "prometheus", "otel", "telemetry", "ffmpeg", "pdf", "mcp",
    "plugin", "worktree", "codex", "hook",
]
KEYWORD_CAP = 15
GO_TEXT = r"(?i)go\.mod|golang|goroutine"
REST_TEXT = r"(?i)restful|REST API|rest_framework"

_W = r"[\p{L}\p{N}_./-]"
_W0 = r"[\p{L}\p{N}_./]"
COMMIT = rf"\[{_W}+\s+([0-9a-f]{{7,40}})\]\s+([^\n]+)"
PULL = r"https://github\.com/[\p{L}\p{N}_.-]+/[\p{L}\p{N}_.-]+/pull/[0-9]+"
GIT_OPERATION = r"\bgit push\b|\bgh pr (?:create|merge)\b"
GITISH = r"\bgit\b|\bgh\b"
REMOVE = r"\brm\b"
REPOSITORY = r"github\.com[:/]([\p{L}\p{N}_.-]+)/([\p{L}\p{N}_][\p{L}\p{N}_.-]*?)(?:\.git)?(?=[/\s\"']|$)"
BRANCHES = [
    rf"git\s+checkout\s+-b\s+({_W0}{_W}*)",
    rf"git\s+switch\s+-c\s+({_W0}{_W}*)",
    rf"git\s+checkout\s+({_W0}{_W}*)",
    rf"git\s+switch\s+({_W0}{_W}*)",
    rf"git\s+push\s+\S+\s+({_W0}{_W}*)",
    rf"--head\s+({_W0}{_W}*)",
    rf"Switched to (?:a new )?branch\s+['\"]?({_W0}{_W}*)",
    rf"On branch\s+({_W0}{_W}*)",
]
BRANCH_REJECTS = ["--", "HEAD", "head", "origin", "."]
WORKTREES = [r"\.worktrees/([\p{L}\p{N}_.-]+)", r"--worktrees-([\p{L}\p{N}_.-]+)"]

OPEN_WORDS = r"(?i)left off|pending|awaiting|next session|\bTODO\b|blocked|on your word"
DONE_WORDS = r"(?i)all tests pass|tests green|✅|\bdone\b|verified|merged|committed|pushed|complete"
PERMISSION = (
    r"(?i)(shall|should|may|can|would|do)\s+(i|you)\b|permission|let me know|awaiting your|could ?n.?t find|missing file|not found|want me to|"
    r"which .{0,40}would you")

TEST_COMMAND = (
    r"(?i)\b(pytest|jest|vitest(?:\s+run)?|mocha|go\s+test|cargo\s+test|npm\s+(?:run\s+)?test|yarn\s+test|pnpm\s+(?:run\s+)?test|npm\s+run\s+build|"
    r"yarn\s+build|pnpm\s+build|next\s+build|tsc\b|playwright\s+test|make\s+test\b|python3?\s+(?:\S*/)?test[\w.]*\.py)\b")
TEST_FAILED = r"(?i)([0-9]+)\s+fail(?:ed|ing|s)?\b"
TEST_PASSED = r"(?i)([0-9]+)\s+pass(?:ed|ing|es)?\b"
FAIL_WORDS = r"(?i)\bFAIL(?:ED)?\b|✗|✘|\bTraceback\b|\bError:"
OK_WORDS = r"(?i)\ball tests? pass|\bPASS\b|✓|\bok\b|\bsucce"

POLLUTION = (
    r"(?i)@@THREADMILL-SUMMARIZER@@|^\s*@@S[0-9]+@@|^\s*(?:You\s+)?refine bullets for\b|^\s*You (?:refine|summari[sz]e) \w+ .*session summaries\b|"
    r"^\s*Summari[sz]e this Claude Code session transcript\b")

#: Starts only where a token can start and never gives back what it took, so that words of any length are read once.
PATH_TOKEN = r"(?<![\p{L}\p{N}_.\-])[~/]?[\p{L}\p{N}_.\-]++(?:/[\p{L}\p{N}_.\-]++)++"
EXCLUDED, PRIVATE = "[excluded-path]", "[private]"
EXCERPT_LIMIT, EXCERPT_HEAD, EXCERPT_TAIL, TRIMMED = 36_000, 24_000, 12_000, "\n...[trimmed]...\n"
PATCH_OPS = {"add": "C", "update": "M", "delete": "D"}
DENIED_ORIGINATORS = ["codex-exec", "codex-subagent", "codex-mcp", "codex-cloud", "codex-automation"]
INJECTED_PREFIX = "# agents.md instructions"
TEXT_PARTS = ["input_text", "output_text", "text", "summary_text"]
SUMMARY_FIELDS = ["asked", "learned", "completed", "left_off", "next_steps"]
SEGMENT_EVENTS = ["precompact", "postcompact", "session_end", "stop", "backfill", "change", "manual", "session_start"]
HOOK_EVENTS = {"PreCompact": "precompact", "PostCompact": "postcompact", "SessionEnd": "session_end", "Stop": "stop", "SessionStart": "session_start"}
