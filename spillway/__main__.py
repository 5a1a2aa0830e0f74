"""python -m spillway"""

import sys

from spillway.cli import main

sys.exit(main())
