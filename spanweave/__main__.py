"""``python -m spanweave``: see ``spanweave.pipeline.main``."""

from spanweave.pipeline import main

raise SystemExit(main())
