"""Line patterns of the two log grammars.

``\\z`` is used for the end of a line, because Java's ``$`` also matches before
a final line terminator, and ``(?s)`` so that ``.`` covers a carriage return.
"""

# The line grammar of aggregated logs.
SEQ_PREFIX = r"(?:\[\s*\d+\]\s+)?"
# An aggregated call whose name is a noise keyword is noise, as noise is dropped first.
API_LINE = rf"^(?!warning:){SEQ_PREFIX}(?!vendor:)(\w+):\s+count=(\d+),\s+time=(\d+)\s+us\z"
# The usual form of it, without prefix and with single blanks.
PLAIN_API_LINE = r"^(?!warning:|vendor:)\w+: count=\d+, time=\d+ us\z"
SWAP_LINE = rf"^{SEQ_PREFIX}swapBuffers:\s+(\d+)\s+us\z"
COST_LINE = rf"^{SEQ_PREFIX}\d+\s+frame\s+cost\s+(\d+)ms\z"
FPS_TEXT = r"libGL:\s+FPS\s*=\s*([\d.]+)"
VENDOR_LINE = rf"^{SEQ_PREFIX}vendor:"
GC_LINE = r"^<<gc = 0x[a-fA-F0-9]+>>\z"
ERROR_LINE = r"(?s)^\[\d+:\d+:\d+.*ERROR"
BROWSER_LINE = r"(?s)^(?:\d+\s+)?\[\d+:\d+:\d+.*\]"
BROWSER_LINE_BARE = r"(?s)^\[\d+:\d+:\d+.*\]"
WARNING_LINE = r"^warning:"
# All of the above that an aggregated log leaves out, tried in one pass over the line.
NOISE_LINE = (
    r"(?s)^(?:(?:\d+\s+)?\[\d+:\d+:\d+.*\]|warning:|\[\d+:\d+:\d+.*ERROR"
    rf"|<<gc = 0x[a-fA-F0-9]+>>\z|{SEQ_PREFIX}vendor:)"
)
# The characters that a line of this kind can begin with.
NOISE_STARTS = [*"0123456789[w<v"]
SHADER_HEADER = r"^\[\s*\d+\]\s+\(gc=[^)]+,\s+tid=[^)]+\):\s+glShaderSource\s+(\d+)\s"
SHADER_FENCE = rf"^{SEQ_PREFIX}####\r?\z"

# Call-name prefixes that mark a raw trace line.
RAW_NAME_PREFIXES = [
    "glX", "eglSwapBuffers", "glGen", "glCreate", "glBind", "glBuffer", "glDraw", "glClear",
    "glUseProgram", "glShader", "glCompile", "glLink", "glVertex", "glPixel", "glTex",
    "glEnable", "glDisable", "glFlush", "glFinish", "glMap", "glUnmap", "glDelete", "glGet",
    "glIs", "glRead",
]

# Raw lines starting with one of these carry no call.
RAW_SKIP_PREFIXES = [" ", "\t", "=", "__", "src:", "dst:", "{", "}", "[__dri3"]

# A line that holds a call once blanks and a sequence prefix are removed.
RAW_CALL_LINE = r"(?sU)^\s*(?:\[[^\]]*\]\s*)?e?gl"

# Calls that end a frame in a raw trace.
RAW_FRAME_ENDS = ["glXSwapBuffers", "eglSwapBuffers", "glSwapBuffers", "eglPresentationTime"]
