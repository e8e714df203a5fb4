import sys

from fragspark.cli import main

sys.exit(main())
