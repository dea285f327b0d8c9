import sys

from keyfold.plans.cli import main

sys.exit(main())
