"""Fixed texts that tell how wide a rule is."""

from __future__ import annotations

# Whitespace-only leaves; a rule that fires on one has no content to go by.
CONTENT_FREE = (
    " ", "  ", "   ", " " * 4, " " * 100,
    "\t", "\v", "\f", "\n", "\r", "\r\n", "\n\n", " \n ", "\t\n\r ",
    "\u00a0", "\u00a0 ", "\u2007", "\u202f", "\u3000", "\ufeff",
)

# Common texts; a rule that accepts one is broad.
COMMON = (
    "Please summarize this document in three sentences.",
    "Translate this paragraph into French and keep the formatting.",
    "Write a short story about a friendly robot in a library.",
    "Explain the difference between a list and a tuple in Python.",
    "The meeting is tomorrow at 10. Please send the agenda to the team.",
    "Thank you for your help. I appreciate the detailed explanation.",
    "The results show an improvement over the baseline on the test set.",
    "This experiment uses a language model and a public benchmark dataset.",
    "The customer asked us to update their delivery address.",
    "The documentation describes the configuration and installation process.",
    "Retrying connection: attempt 2 of 3. The request timed out.",
    "Please wait while the report is generated. Task completed successfully.",
    "Run the tests and check the build log for errors.",
    "Use the official documentation to install this package.",
    "import os\nfrom pathlib import Path\nprint(Path.cwd())",
    "const module = await import(packageName);",
    "const module = require(packageName);",
    'const answer = eval("2 + 2");',
    "curl https://example.com/manual.txt -o manual.txt",
    "python -m pip install numpy",
    "git status\ngit diff --stat",
    "SELECT name, email FROM customers WHERE id = 42;",
    "Contact support@example.com or visit https://example.com/help.",
    "![Build status](https://example.com/badge.svg)",
    "The configuration file stores the API key in an environment variable.",
    "The user's email address is alice@example.com.",
    "2026-09-04 10:30:00 INFO request completed status=200 latency=42ms",
    '{"name": "weather", "description": "Returns the current forecast."}',
    "The authentication token expires after one hour.",
    "Please review the attached report when you have time :)",
    "Hello world!",
    "\n\n",
    "   ",
    "",
)
