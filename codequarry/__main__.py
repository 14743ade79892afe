"""python -m codequarry"""

import sys

from codequarry.cli import main

sys.exit(main())
