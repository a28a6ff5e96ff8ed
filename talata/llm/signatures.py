"""Signature rules of the license scan that stand on their own: (label, priority, confidence, regular expression).

They are patterns over lower-cased text for notices, grants, disclaimers and names that the templates
of ``licenses`` do not make. Higher priorities win where intervals contain each other.
"""

SIGNATURES = [
    # Grants and notices of the GNU family.
    ("gpl", 74, 0.85, r"you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+general\s+public"),
    ("gpl", 72, 0.8, r"you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+gnu\s+general\s+public"),
    ("gpl", 58, 0.7, r"\bcopyleft\b.{0,40}\bgpl\b"),
    ("gpl-2.0", 77, 0.92, r"either\s+version\s+2,?\s+or\s+\(at\s+your\s+option\)\s+any\s+later\s+version"),
    ("gpl-2.0", 76, 0.9, r"\bgpl\s*v\s?2\s+only\b"),
    ("gpl-3.0", 77, 0.92, r"gplv3\s*\+?(?=\W|$)"),
    ("gpl-2.0", 77, 0.92, r"gplv2\s*\+?(?=\W|$)"),
    ("gpl", 66, 0.8, r"\bfree\s+software\s+foundation,\s+inc\.,?\s+(?:59\s+temple\s+place|51\s+franklin)"),
    ("gpl-classpath", 79, 0.93, r"\bclasspath\s+exception\b"),
    ("gpl-linking", 79, 0.9, r"as\s+a\s+special\s+exception,\s+.{0,80}?\blink(?:ing)?\b"),
    ("gpl-font", 79, 0.92, r"\bgpl\s+font\s+exception\b|font\s+exception\s+to\s+the\s+gpl"),
    ("gpl-bison", 79, 0.92, r"\bbison\s+exception\b|parser\s+skeleton\s+.{0,60}?special\s+exception"),
    ("gpl-gcc-runtime", 79, 0.92, r"\bgcc\s+runtime\s+library\s+exception\b"),
    ("gpl-autoconf", 79, 0.92, r"\bautoconf\s+(?:configure\s+script\s+)?exception\b"),
    ("linux-syscall-note", 79, 0.92, r"\blinux-syscall-note\b"),
    ("lgpl", 74, 0.85, r"under\s+the\s+terms\s+of\s+the\s+gnu\s+(?:lesser|library)\s+general\s+public"),
    ("lgpl", 72, 0.8, r"you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+gnu\s+(?:lesser|library)"),
    ("lgpl-3.0", 77, 0.92, r"lgplv3\s*\+?(?=\W|$)"),
    ("lgpl-2.1", 77, 0.92, r"lgplv2\.1\s*\+?(?=\W|$)"),
    ("agpl", 74, 0.85, r"under\s+the\s+terms\s+of\s+the\s+gnu\s+affero"),
    ("agpl-3.0", 77, 0.92, r"agplv3\s*\+?(?=\W|$)"),
    ("gfdl", 74, 0.85, r"permission\s+is\s+granted\s+to\s+copy,\s+distribute\s+and/or\s+modify\s+this\s+document"),
    ("gnu-all-permissive", 76, 0.9, r"copying\s+and\s+distribution\s+of\s+this\s+file,\s+with\s+or\s+without\s+modification,\s+are\s+permitted\s+in\s+any\s+medium"),
    ("gnu-verbatim", 70, 0.8, r"everyone\s+is\s+permitted\s+to\s+copy\s+and\s+distribute\s+verbatim\s+copies"),
    # Permissive bodies and disclaimers.
    ("apache-2.0", 76, 0.92, r"you\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+license"),
    ("apache-2.0", 73, 0.85, r"see\s+the\s+license\s+for\s+the\s+specific\s+language\s+governing\s+permissions\s+and\s+limitations"),
    ("apache-2.0", 71, 0.85, r"grant\s+of\s+patent\s+license\.\s+subject\s+to\s+the\s+terms"),
    ("apache-1.1", 76, 0.9, r"this\s+product\s+includes\s+software\s+developed\s+by\s+the\s+apache\s+software\s+foundation"),
    ("llvm-exception", 79, 0.93, r"\bapache\b.{0,30}\bwith\s+llvm[\s-]exceptions?\b"),
    ("mit", 73, 0.85, r"the\s+above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+shall\s+be\s+included\s+in\s+all\s+copies"),
    ("mit", 64, 0.75, r"the\s+software\s+is\s+provided\s+\"as\s+is\",\s+without\s+warranty\s+of\s+any\s+kind,\s+express\s+or\s+implied"),
    ("mit", 63, 0.75, r"licen[cs]e:\s*mit\b"),
    ("mit-cmu", 76, 0.88, r"\bcmu\s+licen[cs]e\b|carnegie\s+mellon\s+university\b.{0,80}?\bpermission\s+to\s+use"),
    ("mit-feh", 76, 0.88, r"acknowledgment\s+shall\s+be\s+given\s+in\s+the\s+documentation,\s+and\s+software\s+packages"),
    ("mit-advertising", 76, 0.88, r"\bmit\s+with\s+advertising\b"),
    ("mitnfa", 76, 0.9, r"distributions\s+of\s+all\s+or\s+part\s+of\s+the\s+software\s+intended\s+to\s+be\s+used\s+by\s+the\s+recipients"),
    ("bsd", 63, 0.7, r"licen[cs]e:\s*bsd\b"),
    ("bsd", 64, 0.75, r"redistributions\s+of\s+source\s+code\s+must\s+retain\s+the\s+above\s+copyright\s+notice"),
    ("bsd", 64, 0.75, r"redistributions\s+in\s+binary\s+form\s+must\s+reproduce\s+the\s+above\s+copyright\s+notice"),
    ("bsd", 62, 0.7, r"in\s+no\s+event\s+shall\s+the\s+(?:copyright\s+(?:holders?|owner)|regents|authors?)\s+(?:or\s+contributors\s+)?be\s+liable"),
    ("bsd-3-clause", 76, 0.9, r"neither\s+the\s+name\s+of\s+the\s+(?:copyright\s+holder|university|author)"),
    ("bsd-3-clause-clear", 78, 0.93, r"\bclear\s+bsd\s+licen[cs]e\b|no\s+express\s+or\s+implied\s+licenses\s+to\s+any\s+party's\s+patent\s+rights"),
    ("bsd-3-clause-lbnl", 78, 0.92, r"lawrence\s+berkeley\s+national\s+(?:laboratory|labs)\s+bsd"),
    ("bsd-3-clause-nuclear", 78, 0.92, r"not\s+designed,\s+licensed\s+or\s+intended\s+for\s+use\s+in\s+the\s+design,\s+construction,\s+operation\s+or\s+maintenance\s+of\s+any\s+nuclear"),
    ("bsd-2-clause-patent", 78, 0.93, r"\bbsd\s*\+\s*patent\b|bsd-2-clause\s+plus\s+patent"),
    ("bsd-1-clause", 76, 0.9, r"\bbsd[\s-]1[\s-]clause\b|\b(?:one|1)-clause\s+bsd\b"),
    ("bsd-protection", 76, 0.9, r"\bbsd\s+protection\s+licen[cs]e"),
    ("bsd-source-code", 76, 0.9, r"\bbsd\s+source\s+code\s+attribution\b"),
    ("isc", 66, 0.75, r"\bsoftware\s+is\s+provided\s+\"as\s+is\"\s+and\s+(?:isc|the\s+author)\s+disclaims\s+all\s+warranties"),
    ("hpnd", 76, 0.88, r"\bhistorical\s+permission\s+notice\s+and\s+disclaimer\b"),
    ("ntp", 76, 0.88, r"\bntp\s+licen[cs]e\b|david\s+l\.\s+mills\b.{0,80}?permission\s+to\s+use"),
    ("icu", 76, 0.9, r"\bicu\s+licen[cs]e\b"),
    ("unicode", 76, 0.9, r"\bunicode,?\s+inc\.?\s+licen[cs]e\s+agreement|\bunicode\s+licen[cs]e\s+v3"),
    ("curl", 76, 0.88, r"\bcurl\s+licen[cs]e\b|copyright\s+\(c\)\s+.{0,20}daniel\s+stenberg"),
    ("zlib", 72, 0.85, r"in\s+no\s+event\s+will\s+the\s+authors\s+be\s+held\s+liable\s+for\s+any\s+damages\s+arising\s+from\s+the\s+use"),
    ("zlib", 74, 0.85, r"the\s+origin\s+of\s+this\s+software\s+must\s+not\s+be\s+misrepresented"),
    ("bzip2", 76, 0.9, r"\bbzip2\s+licen[cs]e\b"),
    ("libtiff", 76, 0.9, r"\blibtiff\s+licen[cs]e\b|names\s+of\s+sam\s+leffler\s+and\s+silicon\s+graphics"),
    ("ijg", 76, 0.9, r"\bindependent\s+jpeg\s+group('s)?\s+(?:software|licen[cs]e)|based\s+in\s+part\s+on\s+the\s+work\s+of\s+the\s+independent\s+jpeg"),
    ("ftl", 76, 0.9, r"\bfreetype\s+(?:project\s+)?licen[cs]e\b"),
    ("imagemagick", 76, 0.9, r"\bimagemagick\s+licen[cs]e\b"),
    ("info-zip", 76, 0.9, r"\binfo-zip\s+(?:licen[cs]e|copyright)"),
    ("blueoak", 76, 0.92, r"\bblue\s+oak\s+model\s+licen[cs]e"),
    ("beerware", 76, 0.92, r"\bbeer-?ware\s+licen[cs]e|you\s+can\s+buy\s+me\s+a\s+beer\s+in\s+return"),
    ("json", 76, 0.92, r"the\s+software\s+shall\s+be\s+used\s+for\s+good,\s+not\s+evil"),
    ("ssleay", 76, 0.9, r"includes\s+cryptographic\s+software\s+written\s+by\s+eric\s+young"),
    ("postgresql", 74, 0.85, r"in\s+no\s+event\s+shall\s+the\s+university\s+of\s+california\s+be\s+liable\s+to\s+any\s+party"),
    ("tcl", 76, 0.88, r"\btcl/tk\s+licen[cs]e|regents\s+of\s+the\s+university\s+of\s+california,\s+sun\s+microsystems"),
    ("w3c", 76, 0.9, r"\bw3c\s+(?:software\s+(?:notice\s+and\s+)?|document\s+)?licen[cs]e"),
    ("naist", 76, 0.88, r"nara\s+institute\s+of\s+science\s+and\s+technology"),
    ("intel", 76, 0.85, r"\bintel\s+(?:open\s+source|simplified\s+software)\s+licen[cs]e"),
    ("nvidia", 72, 0.8, r"\bnvidia\s+(?:software|source\s+code)\s+licen[cs]e"),
    ("fair", 76, 0.88, r"usage\s+of\s+the\s+works\s+is\s+permitted\s+provided\s+that\s+this\s+instrument\s+is\s+retained"),
    ("fsfap", 74, 0.85, r"\bfsf\s+all\s+permissive\b"),
    ("xfree86", 76, 0.9, r"\bxfree86\s+(?:project\s+)?licen[cs]e|developed\s+by\s+the\s+xfree86\s+project"),
    ("mirOS", 74, 0.88, r"\bmiros\s+licen[cs]e\b"),
    ("spencer", 74, 0.88, r"copyright\s+.{0,20}henry\s+spencer"),
    # Reciprocal licenses of companies and foundations.
    ("mpl-2.0", 76, 0.92, r"if\s+a\s+copy\s+of\s+the\s+mpl\s+was\s+not\s+distributed\s+with\s+this\s+file"),
    ("mpl-1.1", 76, 0.9, r"the\s+contents\s+of\s+this\s+file\s+are\s+subject\s+to\s+the\s+mozilla\s+public"),
    ("mpl-tri", 79, 0.92, r"mpl\s+1\.1/gpl\s+2\.0/lgpl\s+2\.1"),
    ("epl", 60, 0.8, r"\beclipse\s+public\s+licen[cs]e\b"),
    ("edl-1.0", 76, 0.9, r"\beclipse\s+distribution\s+licen[cs]e\b"),
    ("ipl-1.0", 76, 0.9, r"\bibm\s+public\s+licen[cs]e\b"),
    ("npl", 76, 0.9, r"\bnetscape\s+public\s+licen[cs]e\b"),
    ("spl-1.0", 76, 0.9, r"\bsun\s+public\s+licen[cs]e\b"),
    ("sissl", 76, 0.9, r"\bsun\s+industry\s+standards\s+source\s+licen[cs]e\b"),
    ("apsl", 76, 0.9, r"\bapple\s+public\s+source\s+licen[cs]e\b"),
    ("rpl-1.5", 76, 0.9, r"\breciprocal\s+public\s+licen[cs]e\b"),
    ("rpsl-1.0", 76, 0.9, r"\brealnetworks\s+public\s+source\s+licen[cs]e\b"),
    ("nasa-1.3", 76, 0.9, r"\bnasa\s+open\s+source\s+agreement\b"),
    ("nokia", 76, 0.88, r"\bnokia\s+open\s+source\s+licen[cs]e\b"),
    ("motosoto", 76, 0.88, r"\bmotosoto\s+open\s+source\s+licen[cs]e\b"),
    ("lucent", 76, 0.88, r"\blucent\s+public\s+licen[cs]e\b"),
    ("sybase", 76, 0.88, r"\bsybase\s+open\s+watcom\s+public\s+licen[cs]e\b"),
    ("watcom", 72, 0.85, r"\bopen\s+watcom\s+public\b"),
    ("ecos", 76, 0.88, r"\becos\s+licen[cs]e\b|red\s+hat\s+ecos\s+public\s+licen[cs]e"),
    ("cpal-1.0", 76, 0.9, r"\bcommon\s+public\s+attribution\s+licen[cs]e\b"),
    ("cua-opl", 76, 0.9, r"\bcua\s+office\s+public\s+licen[cs]e\b"),
    ("ecl-2.0", 76, 0.9, r"\beducational\s+community\s+licen[cs]e\b"),
    ("efl-2.0", 76, 0.9, r"\beiffel\s+forum\s+licen[cs]e\b"),
    ("entessa", 76, 0.9, r"\bentessa\s+public\s+licen[cs]e\b"),
    ("frameworx", 76, 0.9, r"\bframeworx\s+(?:open\s+)?licen[cs]e\b"),
    ("ipa", 76, 0.9, r"\bipa\s+font\s+licen[cs]e\b"),
    ("lppl", 76, 0.9, r"\blatex\s+project\s+public\s+licen[cs]e\b|\blppl\b"),
    ("multics", 76, 0.88, r"\bmultics\s+licen[cs]e\b"),
    ("naumen", 76, 0.88, r"\bnaumen\s+public\s+licen[cs]e\b"),
    ("ngpl", 76, 0.88, r"\bnethack\s+general\s+public\s+licen[cs]e\b"),
    ("oclc-2.0", 76, 0.88, r"\boclc\s+research\s+public\s+licen[cs]e\b"),
    ("oset-pl", 76, 0.88, r"\boset\s+(?:foundation\s+)?public\s+licen[cs]e\b"),
    ("ricoh", 76, 0.88, r"\bricoh\s+source\s+code\s+public\s+licen[cs]e\b"),
    ("simpl-2.0", 76, 0.88, r"\bsimple\s+public\s+licen[cs]e\b"),
    ("sleepycat", 76, 0.9, r"\bsleepycat\s+(?:software\s+)?licen[cs]e\b"),
    ("vsl-1.0", 76, 0.88, r"\bvovida\s+software\s+licen[cs]e\b"),
    ("wxwindows", 76, 0.9, r"\bwxwi(?:ndows|dgets)\s+(?:library\s+)?licen[cs]e\b"),
    ("zpl", 76, 0.9, r"\bzope\s+public\s+licen[cs]e\b|\bzpl\s+[12]\.\d\b"),
    ("cnri-python", 76, 0.9, r"\bcnri\s+(?:open\s+source\s+)?licen[cs]e\s+agreement"),
    ("catosl", 76, 0.88, r"\bcomputer\s+associates\s+trusted\s+open\s+source\s+licen[cs]e\b"),
    ("eudatagrid", 76, 0.88, r"\beu\s+datagrid\s+software\s+licen[cs]e\b"),
    ("parity", 76, 0.88, r"\bparity\s+public\s+licen[cs]e\b"),
    ("copyfree", 58, 0.7, r"\bcopyfree\b"),
    ("liliq", 76, 0.9, r"\blicence\s+libre\s+du\s+qu[ée]bec\b"),
    ("etalab-2.0", 76, 0.9, r"\b(?:licence\s+ouverte|open\s+licence)\b.{0,20}\betalab\b|\betalab\s+(?:open\s+)?licence\b"),
    ("ogl-uk", 76, 0.92, r"\bopen\s+government\s+licen[cs]e\b"),
    ("dl-de-by", 76, 0.9, r"\bdatenlizenz\s+deutschland\b"),
    # Source-available and model licenses.
    ("polyform-nc", 76, 0.92, r"\bpolyform\s+noncommercial\b"),
    ("polyform-sb", 76, 0.92, r"\bpolyform\s+small\s+business\b"),
    ("polyform-shield", 76, 0.92, r"\bpolyform\s+shield\b"),
    ("commons-clause", 78, 0.93, r"\bcommons\s+clause\b"),
    ("confluent", 76, 0.9, r"\bconfluent\s+community\s+licen[cs]e\b"),
    ("redis-sal", 76, 0.9, r"\bredis\s+source\s+available\s+licen[cs]e\b"),
    ("timescale", 76, 0.9, r"\btimescale\s+licen[cs]e\b"),
    ("cockroach", 76, 0.9, r"\bcockroachdb\s+community\s+licen[cs]e\b"),
    ("fsl-1.1", 76, 0.92, r"\bfunctional\s+source\s+licen[cs]e\b"),
    ("hippocratic", 76, 0.92, r"\bhippocratic\s+licen[cs]e\b"),
    ("anti-996", 76, 0.92, r"\banti[\s-]996\s+licen[cs]e\b"),
    ("gemma", 76, 0.9, r"\bgemma\s+terms\s+of\s+use\b"),
    ("falcon", 76, 0.88, r"\bfalcon(?:-180b)?\s+(?:llm\s+|tii\s+)licen[cs]e\b"),
    ("bigscience-rail", 77, 0.92, r"\bbigscience\s+(?:open\s*)?rail\b"),
    ("bigcode-openrail", 77, 0.92, r"\bbigcode\s+open\s*rail\b"),
    ("nc-research", 60, 0.7, r"\bfor\s+(?:non-?commercial\s+)?research\s+purposes\s+only\b"),
    # Documents, art and data.
    ("cc-pdm", 76, 0.9, r"\bpublic\s+domain\s+mark\b"),
    ("cc-sampling", 76, 0.9, r"\bcreative\s+commons\s+sampling(?:\s+plus)?\b"),
    ("cc-devnations", 76, 0.9, r"\bdeveloping\s+nations\s+licen[cs]e\b"),
    ("cc", 48, 0.6, r"\bcreative\s+commons\s+licen[cs]e"),
    ("cc-by-nc", 61, 0.75, r"\battribution[\s-]+non-?commercial\b"),
    ("cc-by-sa", 61, 0.75, r"\battribution[\s-]+share-?alike\b"),
    ("cc-by-nd", 61, 0.75, r"\battribution[\s-]+no-?deriv(?:ative)?s\b"),
    ("fal-1.3", 76, 0.9, r"\bfree\s+art\s+licen[cs]e\b|\blicence\s+art\s+libre\b"),
    ("opl-1.0", 76, 0.88, r"\bopen\s+publication\s+licen[cs]e\b"),
    ("ocl", 74, 0.85, r"\bopen\s+content\s+licen[cs]e\b"),
    ("dsl", 76, 0.88, r"\bdesign\s+science\s+licen[cs]e\b"),
    ("fdl-bsd", 76, 0.88, r"\bfreebsd\s+documentation\s+licen[cs]e\b"),
    ("ogl-1.0a", 76, 0.9, r"\bopen\s+game\s+licen[cs]e\b"),
    ("cdla-permissive", 76, 0.92, r"\bcommunity\s+data\s+licen[cs]e\s+agreement\b.{0,20}\bpermissive\b|\bcdla-permissive\b"),
    ("cdla-sharing", 76, 0.92, r"\bcommunity\s+data\s+licen[cs]e\s+agreement\b.{0,20}\bsharing\b|\bcdla-sharing\b"),
    ("gutenberg", 72, 0.85, r"\bproject\s+gutenberg(?:-tm|™)?\s+licen[cs]e\b"),
    ("arxiv", 72, 0.85, r"\barxiv(?:\.org)?\s+(?:perpetual,?\s+)?non-?exclusive\s+licen[cs]e\b"),
    ("oa-springer", 60, 0.7, r"this\s+article\s+is\s+an\s+open\s+access\s+article\s+distributed\s+under"),
    ("crown", 72, 0.85, r"\bcrown\s+copyright\b"),
    ("us-gov", 72, 0.85, r"\bwork\s+of\s+the\s+(?:united\s+states|u\.s\.)\s+government\b"),
    # Proprietary notices and general statements.
    ("proprietary", 56, 0.75, r"\bproprietary\s+and\s+confidential\b|\bconfidential\s+and\s+proprietary\b"),
    ("proprietary", 56, 0.75, r"\bunauthori[sz]ed\s+(?:copying|reproduction|use|distribution)\b.{0,60}?\b(?:prohibited|forbidden)\b"),
    ("proprietary", 55, 0.7, r"\bmay\s+not\s+be\s+(?:reproduced|copied|redistributed)\b.{0,60}?\bwithout\b.{0,40}?\bpermission\b"),
    ("proprietary", 55, 0.7, r"\bend[\s-]user\s+licen[cs]e\s+agreement\b|\beula\b"),
    ("proprietary", 54, 0.65, r"\btrade\s+secrets?\s+of\b"),
    ("public-domain", 55, 0.7, r"\bno\s+rights\s+reserved\b"),
    ("public-domain", 56, 0.75, r"\bnot\s+subject\s+to\s+copyright\b"),
    ("public-domain", 56, 0.75, r"\bdisclaims?\s+(?:all\s+)?copyright\s+to\s+this\b"),
    ("public-domain", 52, 0.65, r"\bin\s+the\s+public\s+domain\b"),
    ("some-rights", 50, 0.6, r"\bsome\s+rights\s+reserved\b"),
    ("dual", 50, 0.55, r"\bdual[\s-]licen[cs]ed\b"),
    ("open-source", 40, 0.4, r"\breleased\s+as\s+open[\s-]source\b"),
]
