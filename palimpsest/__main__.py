import sys

from palimpsest.api import main

sys.exit(main())
